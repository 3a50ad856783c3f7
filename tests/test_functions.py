import datetime as dt
import math
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalbook.functions import dates, geo, text
from tidalbook.plans.examples import EXAMPLES
from tidalbook.schema import CATEGORIES


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_rule_table_order_and_word_ends(spark):
    cases = {
        "Mercado Livre": "comida", "mercado bitcoin": "comida", "Livraria Cultura": "lazer", "imposto": "transporte", "Uber Eats": "comida", "UBER": "transporte", "cafeé": "comida",
        "CAFÉ": "comida", "cafes": "desconhecido", "barra": "desconhecido", "bar": "lazer", "Pão de Açúcar": "comida", "PAO DE ACUCAR": "comida", "açoes": "desconhecido", "acoes": "investimento",
        "  pix ": "transferencia", "": "desconhecido", "comgas": "moradia", "mensalidade escolar": "educacao", "xp investimentos": "investimento", "supermercado": "comida",
        "claro internet": "moradia", "decimo terceiro": "salario",
    }
    assert one(spark, cases, text.categorize) == list(cases.values())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_categories_are_total(spark, texts):
    assert set(one(spark, [t.replace("\x00", "") for t in texts], text.categorize)) <= set(CATEGORIES)


def test_null_text_is_unknown(spark):
    assert one(spark, [None], text.categorize) == ["desconhecido"]


def test_custom_rules(spark):
    table = {"mine": ("b.", "uv"), "yours": ("uvw", "xy")}
    assert one(spark, ["abc", "xyz", "uvw", "q"], lambda c: text.categorize(c, table)) == ["mine", "yours", "mine", "desconhecido"]


def test_each_pattern_has_an_example_that_only_it_explains(spark):
    """230 patterns, each with a text that it matches; the table without covered patterns gives the same."""
    import re

    assert sum(map(len, text.PATTERNS.values())) == 230 and len(EXAMPLES) > 230
    texts = [t.lower() for t in EXAMPLES]
    for category, patterns in text.PATTERNS.items():
        for p in patterns:
            assert any(re.search(p, t) for t in texts), p
    assert one(spark, EXAMPLES, text.categorize) == list(EXAMPLES.values())


def test_covered_patterns_change_nothing(spark):
    """The full table tried pattern by pattern, the pruned one, and the one by alternations agree on texts made of pieces of patterns."""
    import re

    rng = random.Random(11)
    pieces = [w for t in EXAMPLES for w in t.split()] + ["", " ", "x", "s", "-", "é", "1"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))) for _ in range(1500)]

    def plain(t):
        t = t.strip().lower()
        return next((c for c, patterns in text.PATTERNS.items() for p in patterns if re.search(p.replace(r"\b", "(?![0-9A-Za-z_])"), t)), "desconhecido")

    want = [plain(t) for t in texts]
    assert one(spark, texts, text.categorize) == want == one(spark, texts, text.categorize_by_patterns)
    dropped = {p for c in text.PATTERNS for p in set(text.PATTERNS[c]) - set(text.needed_rules()[c])}
    assert "supermercado" in dropped and r"livraria\s*cultura" in dropped and "uber" not in dropped and r"cafe\b" not in dropped


def test_statement_times(spark):
    cases = {
        "20240115120000[-03:BRT]": "2024-01-15T12:00:00-03:00", "20240115": "2024-01-15T00:00:00Z", "20240115120000.000": "2024-01-15T12:00:00Z", "2024011512[5:X]": "2024-01-15T12:00:00+05:00",
        " 202401151234 ": "2024-01-15T12:34:00Z", "20240115120000.123[+10:EST]": "2024-01-15T12:00:00+10:00", "20240115[0]": "2024-01-15T00:00:00+00:00", "20240115120000[-0:GMT]": "2024-01-15T12:00:00+00:00",
        "20240115120": "2024-01-15T12:00:00Z", "2024": "now", "": "now", "x20240115": "now",
    }
    assert one(spark, cases, lambda c: dates.parse_ofx_date(c, F.lit("now"))) == list(cases.values())
    assert one(spark, [None], lambda c: dates.parse_ofx_date(c, F.lit("now"))) == ["now"]


def test_sql_functions(spark):
    from tidalbook.functions import sql

    names = sql.register(spark)
    got = spark.sql(
        "select categorize('  Uber Eats') as a, category_label('comida') as b, parse_amount('R$ 1.234,56') as c, format_brl(1234.5) as d, parse_ofx_date('20240115120000[-03:BRT]', 'n') as e, "
        "detect_bank('Nubank', 'x') as f, extract_merchant('Compra em PADARIA no valor') as g, is_purchase(null, 'compra') as h, round(distance_meters(0, 0, 1, 1)) as i, extract_amount('R$ 15 em') as j, "
        "format_moment(timestamp'2024-03-05 07:08:00') as k"
    ).first()
    assert len(names) == 13 and [str(x) for x in got] == [
        "comida", "Alimentação", "1234.56", "R$\xa01.234,50", "2024-01-15T12:00:00-03:00", "Nubank", "padaria", "True", "156899.0", "15.00", "05 de mar. de 2024, 07:08",
    ]


def test_money_text(spark):
    assert one(spark, ["1234567.5", "-0.05", "999.99"], lambda c: text.format_brl(c.cast("decimal(15,2)"))) == ["R$\xa01.234.567,50", "-R$\xa00,05", "R$\xa0999,99"]
    assert one(spark, ["50.00", "50.10", "0.00", "1234.5"], lambda c: text.plain_number(c.cast("decimal(15,2)"))) == ["50", "50.1", "0", "1234.5"]


def test_moment_text(spark):
    got = one(spark, [dt.datetime(2024, 3, 5, 7, 8)], text.format_moment, "timestamp_ntz")
    assert got == ["05 de mar. de 2024, 07:08"]


def test_account_names_and_keys(spark):
    df = spark.createDataFrame([("  ", "9"), (" Minha ", "9"), (None, "")], "a string, b string")
    assert [r[0] for r in df.select(text.account_name(F.col("a"), F.col("b"))).collect()] == ["Conta 9", "Minha", "Conta OFX"]
    assert [r[0] for r in df.select(text.external_id_ofx(F.col("b"), F.lit("f"))).collect()] == ["ofx_9_f", "ofx_9_f", "ofx_unknown_f"]


def test_millis_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert one(spark, [dt.datetime(1970, 1, 1, 0, 0, 1)], dates.millis, "timestamp_ntz") == [1000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rolling_days(spark):
    a, b = dates.rolling_days(F.lit(dt.datetime(2024, 3, 1)))
    assert tuple(spark.range(1).select(a, b).first()) == ("2024-01-31", "2024-03-01")


def vincenty(lat1, lng1, lat2, lng2):
    a, f = geo.AXIS, geo.FLATTENING
    b = (1 - f) * a
    u1, u2, el = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2))), math.radians(lng2 - lng1)
    lam = el
    for _ in range(100):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma, sa = math.atan2(s, c), math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        ca2 = 1 - sa * sa
        cm = c - 2 * math.sin(u1) * math.sin(u2) / ca2 if ca2 else 0
        k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        new = el + (1 - k) * f * sa * (sigma + k * s * (cm + k * c * (2 * cm * cm - 1)))
        if abs(new - lam) < 1e-13:
            break
        lam = new
    q = ca2 * (a * a - b * b) / (b * b)
    big, small = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))), q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    ds = small * s * (cm + small / 4 * (c * (2 * cm * cm - 1) - small / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))
    return b * big * (sigma - ds)


def test_distance_is_close_to_the_iterative_formula(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(-60, 60), rng.uniform(-179, 179)) for _ in range(300)]
    pairs = [(a, b, a + rng.uniform(-0.3, 0.3), b + rng.uniform(-0.3, 0.3)) for a, b in pts] + [(1.0, 2.0, 1.0, 2.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.distance(*(F.col(x) for x in "abcd"))).collect()]
    assert max(abs(g - vincenty(*p)) for g, p in zip(got, pairs, strict=True)) < 0.2


def test_nearby_is_within_radius_and_sorted(spark):
    rng = random.Random(5)
    rows = [(str(i), -23.5 + rng.uniform(-0.2, 0.2), -46.6 + rng.uniform(-0.2, 0.2)) for i in range(500)] + [("n", None, None), ("z", -23.5, -46.6)]
    df = spark.createDataFrame(rows, "id string, latitude double, longitude double")
    got = geo.nearby(df, "-23.5", -46.6, 9000, most=1000).collect()
    want = {i for i, a, b in rows if a is not None and vincenty(-23.5, -46.6, a, b) <= 9000}
    assert {r["id"] for r in got} == want and got[0]["id"] == "z"
    assert [r["distance_meters"] for r in got] == sorted(r["distance_meters"] for r in got)


def test_search_arguments_are_checked():
    import pytest

    for bad in ((91, 0, 1), (0, 181, 1), (0, 0, 0), (0, 0, 50_001)):
        with pytest.raises(ValueError):
            geo.checked(*bad)
    assert geo.checked("1", "2") == (1.0, 2.0, 1000.0)
