"""License scan: exact set-similarity join of text blocks with license templates.

A block is a line of a text; a long line is cut into blocks of ``BLOCK`` words
that overlap by half.  So are the words of the whole text, whatever its line
feeds, as notices are often wrapped.  For templates of more than half a block
the blocks are windows of the whole text that are twice as long as the template
at least, so that a notice always lies in one.  A block matches a template if it
holds at least ``threshold`` of the template's distinct words (containment); of a
short template, within about as many words as it has, so that ordinary sentences
of the same words are none.  Template words
are put in one global order, rarest in the corpus first.  A block that meets
the threshold must hold one of a template's first ``|T| - need + 1`` words
(prefix filter) and have ``need`` distinct words at least (length filter); with
the first common word at position i of the template, at most ``|T| - i`` words
can be common (positional filter).  What passes is counted exactly.

Templates are a fixed, short list, so they travel with the task; the corpus is
read once for the word counts and once for the join, and nothing is shuffled
but the counts of template words.

``base`` phrases are found where their words stand consecutively, anywhere in
the text.  Null and empty texts have no words, no labels and score 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK, THRESHOLD = 64, 0.9
#: Phrases and labels that always count.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public license notices, in words, and the labels this method gives.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the creative commons attribution license cc by": "cc-by",
    "licensed under the creative commons attribution sharealike license cc by sa": "cc-by-sa",
    "licensed under the creative commons attribution noncommercial license cc by nc": "cc-by-nc",
    "this work is dedicated to the public domain cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
    # whole notices
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
    "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied "
    "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
    "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
    "software or the use or other dealings in the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of "
    "source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above "
    "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software "
    "is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
    "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
    "business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license "
    "at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
    "an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
    "limitations under the license": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
    "foundation either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you "
    "should have received a copy of the gnu general public license along with this program": "gnu",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
    "this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages "
    "whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
    "the use or performance of this software": "isc",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either "
    "in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
    "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
    "subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered "
    "source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any "
    "source distribution": "zlib",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2",
}

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased stay, others become a space.
_WORD = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c > 127 else 32 for c in range(256))
_WORD_LINES = _WORD[:10] + b"\n" + _WORD[11:]


def words_of(text: str | None) -> list[bytes]:
    # the spaces that stay are 0x20 alone: split on it only, as other bytes of white space are mapped already
    return [w for w in (text or "").encode().translate(_WORD).split(b" ") if w]


def windows(words: list[bytes], width: int = BLOCK) -> Iterator[list[bytes]]:
    if len(words) <= width:
        yield words
    else:
        for i in range(0, len(words) - width // 2, width // 2):
            yield words[i : i + width]


def width_of(size: int) -> int:
    """Words of a block for a template of ``size`` words: a power of two times ``BLOCK``, and twice ``size`` at least."""
    width = BLOCK
    while width < 2 * size:
        width *= 2
    return width


def reach_of(size: int) -> int | None:
    """Words within which a template of ``size`` words has to stand: itself and a fifth more; longer ones anywhere in a block."""
    return size + max(1, size // 5) if size <= BLOCK // 2 else None


def most_within(block: list[bytes], whole: frozenset[bytes], reach: int) -> int:
    """The most different words of ``whole`` that stand in ``reach`` consecutive words of the block."""
    seen: Counter = Counter()
    most = 0
    for i, w in enumerate(block):
        if i >= reach and (old := block[i - reach]) in whole:
            seen[old] -= 1
            if not seen[old]:
                del seen[old]
        if w in whole:
            seen[w] += 1
            most = max(most, len(seen))
    return most


def needed(size: int, threshold: float) -> int:
    """The fewest common words that meet the threshold."""
    k = int(size * threshold)
    return max(1, k if k >= size * threshold - 1e-9 else k + 1)


def word_counts(df: DataFrame, text: str, vocabulary: list[bytes]) -> dict[bytes, int]:
    """In how many texts each template word stands, over all rows; at most one number per template word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        wanted = frozenset(vocabulary)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    seen.update(wanted.intersection(x.encode().translate(_WORD).split(b" ")))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = df.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


class Index:
    """Templates with their words in the global order, and by width of block the prefix words' lists."""

    def __init__(self, templates: dict[str, str], base: dict[str, str], counts: dict[bytes, int], threshold: float):
        self.base = [(p.encode(), label) for p, label in base.items()]
        self.sets: list[tuple] = []
        self.prefix: dict[int, dict[bytes, list[int]]] = {}
        for t, label in templates.items():
            words = sorted({w.encode() for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
            need = needed(len(words), threshold)
            k = len(self.sets)
            self.sets.append((frozenset(words), need, label, {w: i for i, w in enumerate(words)}, reach_of(len(t.split()))))
            own = self.prefix.setdefault(width_of(len(t.split())), {})
            for w in words[: len(words) - need + 1]:
                own.setdefault(w, []).append(k)
        # one search for any prefix word between spaces
        self.any = {width: re.compile(b" (?:" + b"|".join(sorted(map(re.escape, own))) + b") ") for width, own in self.prefix.items()}

    def blocks(self, text: bytes, words: list[bytes], width: int) -> Iterator[list[bytes]]:
        lines = text.translate(_WORD_LINES).split(b"\n") if width == BLOCK else []
        for line in lines:
            if self.any[width].search(b" " + line + b" "):
                yield from windows([w for w in line.split(b" ") if w])
        if len(lines) != 1:
            yield from windows(words, width)

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        raw = (text or "").encode()
        words = [w for w in raw.translate(_WORD).split(b" ") if w]
        flat = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in self.base:
            at, upto, before = flat.find(b" " + phrase + b" "), 0, 0
            while at >= 0:
                before += flat.count(b" ", upto, at)  # words before the place
                upto = at
                places.append(before)
                labels.add(label)
                at = flat.find(b" " + phrase + b" ", at + 1)
        more, score = set(labels), 1.0 if labels else 0.0
        for width, prefix in self.prefix.items():
            if not self.any[width].search(flat):
                continue
            for block in self.blocks(raw, words, width):
                own = set(block)
                for k in {k for w in own & prefix.keys() for k in prefix[w]}:
                    whole, need, label, order, reach = self.sets[k]
                    if len(own) < need:
                        continue
                    if len(whole) - min(order[w] for w in own & whole) < need:
                        continue
                    common_words = len(own & whole)
                    if common_words >= need and reach is not None:
                        common_words = most_within(block, whole, reach)
                    if common_words >= need:
                        more.add(label)
                        score = max(score, common_words / len(whole))
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: key, counts, first and last base place, labels and the best containment."""
    vocabulary = sorted({w.encode() for t in templates for w in t.split()})
    index = Index(templates, base, word_counts(df, text, vocabulary), threshold)

    def batch(b: pa.RecordBatch) -> dict:
        cols = list(zip(*map(index.scan, b.column(1).to_pylist()), strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return {key: b.column(0)} | {n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)}

    schema = f"`{key}` {dict(df.dtypes)[key]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return common.arrow_map(df.select(key, text), batch, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
