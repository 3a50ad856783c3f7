"""One description for each classification pattern, in the table's order, and the category that it must give."""

from __future__ import annotations

_BY_CATEGORY = {
    "comida": "iFood Pedido; RAPPI Brasil; Uber Eats SP; Restaurante Sol; Lanchonete Boa; Padaria Real; Supermercado Azul; Mercado Central; Hortifruti Verde; Açougue Bom; ACOUGUE BOM; "
    "Pizzaria Roma; Burger Hill; McDonalds 12; Subway Centro; Starbucks Paulista; CAFÉ Novo; cafe 21; Confeitaria Doce; Sushi Ya; Pão de Açúcar; PAO DE ACUCAR; Carrefour Bairro; "
    "Extra Hiper; Atacadão Sul; Atacadao Sul; Assaí Norte; ASSAI NORTE; Zaffari POA; Big Bompreço",
    "transporte": "Uber Viagem; 99 Pop; Cabify BR; Combustível Aditivado; Combustivel comum; Gasolina aditivada; Posto Sete; Shell Select; Ipiranga AM; BR Distribuidora; Estacionamento Sul; "
    "Parking Lot; Pedágio Anchieta; PEDAGIO ANCHIETA; Metro SP; METRÔ Rio; Ônibus 42; ONIBUS 42; Bilhete Único; Bilhete Unico; Sem Parar; Veloe Tag; Move  Mais",
    "assinaturas": "Netflix; SPOTIFY AB; Amazon Prime; Disney Plus; HBO GO; Max; Globoplay; YouTube Premium; AppleMusic; Deezer; Paramount; Crunchyroll; Xbox Game Pass; PlayStation Plus; Adobe; "
    "Microsoft 365; Google One; Dropbox; iCloud; Notion; ChatGPT; OpenAI",
    "lazer": "Cinema; Teatro; Show; Ingresso; Parque; Museu; Bar; Balada; Boliche; Karaoke; Games; Steam; PlayStation Store; Xbox Store; Nintendo; Livraria; Livro; Amazon.com; Shopee; "
    "AliExpress; Shein; Magazine Luiza; Magalu; Americanas; Casas Bahia",
    "saude": "Farmácia Vida; FARMACIA VIDA; Drogaria; Drogasil; Droga Raia; Panvel; Hospital; Clínica; Clinica; Médico; Medico; Dentista; Laboratório; Laboratorio; Consulta; Exame; "
    "Fisioterapia; Psicólogo; Psicologo; Academia; Smart Fit; Bio Ritmo; Gympass; Wellhub; Unimed; Amil; Bradesco Saúde; SulAmérica; Sulamerica",
    "educacao": "Escola; Faculdade; Universidade; Curso; Udemy; Coursera; Alura; Rocketseat; Platzi; Mensalidade Escolar; Material Escolar; Duolingo; English; Idioma",
    "moradia": "Aluguel; Condomínio; Condominio; IPTU; Luz; Energia; Enel; CPFL; Cemig; Eletropaulo; ÁGUA; Agua; Sabesp; Copasa; Gás; Gas; Comgás; Comgas; Internet; Vivo Fibra; "
    "Claro Fibra; TIM Live; Oi Fibra; Seguro Residencial; Manutenção; Manutencao; Reforma",
    "salario": "Salário; Salario; Pagamento Folha; Holerite; Pró-Labore; Pro labore; Décimo Terceiro; Decimo Terceiro; Férias; Ferias; FGTS; PIS; Abono; Bonificação; Bonificacao; "
    "Comissão; Comissao; Freelance; Pagamento Recebido",
    "investimento": "Investimento; Aplicação; Aplicacao; Resgate; CDB; LCI; LCA; Tesouro Direto; Ações; Acoes; FII; Fundo Imobiliario; ETF; Bitcoin; BTC; Ethereum; Cripto; Crypto; Binance; "
    "Nuinvest; Rico; Clear; XP Inc; Modal; BTG Pactual; Rendimento; Dividendo",
    "transferencia": "Pix; Transferência; Transferencia; TED; DOC; Depósito; Deposito; Saque; Pagamento de Boleto; Boleto",
}
#: Patterns that an earlier category's always beat, and texts that come close to a pattern.
_OTHERS = {
    "Mercado Livre": "comida", "Mercado Bitcoin": "comida", "Livraria Cultura": "lazer", "Livraria Saraiva": "lazer",
    "Maximo": "desconhecido", "Barra": "desconhecido", "Showroom": "desconhecido", "cafezal": "desconhecido", "Metrologia": "desconhecido", "Luzia": "desconhecido", "": "desconhecido",
    "TEDx": "desconhecido", "docs": "desconhecido", "Pixel": "desconhecido", "amazon_com": "desconhecido", "99 centavos": "desconhecido", "Fundo de Reserva": "desconhecido",
}
EXAMPLES = {text: category for category, texts in _BY_CATEGORY.items() for text in texts.split("; ")} | _OTHERS
