"""Forms of a lexicon in torn, hyphenated and transliterated text, found by one automaton over all forms.

A form stands in a text if its letters do, in order and any case, with up to two blanks or hyphens between letters of a word, at
least one between words, and no letter right before or behind; ``functions.text.form_matches`` says the same of one form by a
regular expression.  Here the blanks and hyphens are taken out of the text, one automaton finds the letters of all forms and
their script variants in a single reading, and each place is then checked against the gaps that the text had there.  So the work
for a text grows with its length and its near hits, not with the number of forms.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.functions.text import canonical, expanded, script_variants
from linkfold.operators.spread import spread
from linkfold.operators.tables import written

#: Letters of forms and variants in one automaton (some 200 MB at most); larger lexicons are searched for in blocks.
LETTERS = 1_000_000
#: Blanks or hyphens allowed between two letters of a word.
TORN = 2
_SPACES = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_GAP = re.compile(f"[{_SPACES}-]+")
_CUT = re.compile(r"[\s\-]+", re.ASCII)


@lru_cache(maxsize=100_000)
def folded(c: str) -> str:
    """A character as it is compared: by its single upper and lower case, where it has these."""
    up = c.upper() if len(c.upper()) == 1 else c
    return up.lower() if len(up.lower()) == 1 else up


@lru_cache(maxsize=100_000)
def is_letter(c: str) -> bool:
    """Whether a character continues a word: letters, marks, decimal digits, letter numbers, connectors and joiners."""
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍" or "Ⓐ" <= c <= "ⓩ"


class Forms:
    """An automaton over variants of forms; ``rows`` are (number, variants)."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        import ahocorasick

        self.shapes: list[list[tuple[int, int, frozenset[int]]]] = []  # by letters: number, length, places at which words begin
        places: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for number, variants in rows:
            for variant in variants:
                words = [w for w in _CUT.split(variant) if w]
                letters = "".join(map(folded, _GAP.sub("", "".join(words))))
                if not letters or any(_GAP.search(w) for w in words):  # a form whose own letters are blanks of another kind
                    continue
                starts, at = set(), 0
                for w in words[:-1]:
                    at += len(w)
                    starts.add(at)
                if letters not in places:
                    places[letters] = len(self.shapes)
                    self.shapes.append([])
                    self.automaton.add_word(letters, places[letters])
                self.shapes[places[letters]].append((number, len(letters), frozenset(starts)))
        if self.shapes:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> set[int]:
        """Numbers of the forms that stand in the text."""
        found: set[int] = set()
        if not text or not self.shapes:
            return found
        odd = {c: f for c in set(text) if (f := folded(c)) != c}
        if odd:
            text = text.translate({ord(c): f for c, f in odd.items()})
        pieces, gaps, outer = [], {}, {}  # gaps before places of the squeezed text, where there are any, and what stands there
        at = last = 0
        for gap in _GAP.finditer(text):
            pieces.append(text[last : gap.start()])
            at += gap.start() - last
            gaps[at], outer[at] = gap.end() - gap.start(), True
            last = gap.end()
        squeezed = "".join(pieces) + text[last:]
        n = len(squeezed)
        for end, shape in self.automaton.iter(squeezed):
            stop = end + 1
            if stop < n and stop not in outer and is_letter(squeezed[stop]):
                continue
            for number, length, starts in self.shapes[shape]:
                start = stop - length
                if number in found or (start and start not in outer and is_letter(squeezed[start - 1])):
                    continue
                if all(gaps.get(start + k, 0) <= TORN if k not in starts else start + k in gaps for k in range(1, length)):
                    found.add(number)
        return found


def _finder(known):
    """The numbers of the forms in each text, for forms that are broadcast."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Forms(known.value)
        for texts in batches:
            yield pd.Series([sorted(block.find(t)) for t in texts], dtype=object)

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return find


def torn_hits(texts: DataFrame, lexicon: DataFrame, transliterated: bool = True) -> DataFrame:
    """(id, lexicon, canon, canon_pos, form, n_words, freq): the forms that stand in ``texts`` (id, text), torn or in another script.

    lexicon: lexicon, canon, canon_pos, form, n_words, and optionally freq, the form's frequency in the catalogue (else 0), by which
    ``lexicon.first_hits`` chooses.  With ``transliterated`` texts and forms are read in both scripts.  Null and empty texts and
    forms match nothing; repeated rows of texts give their hits once for each id.
    """
    freq = F.col("freq").cast("long") if "freq" in lexicon.columns else F.lit(0).cast("long")
    forms = lexicon.select("lexicon", "canon", "canon_pos", "form", "n_words", freq.alias("freq")).distinct().filter("form is not null")
    forms = forms.withColumn("variants", script_variants(F.col("form")) if transliterated else F.array(canonical(F.col("form"))))
    forms = written(forms, "forms")  # read once for their number and once for each block
    letters = forms.agg(F.sum(F.length(F.array_join("variants", "")))).first()[0] or 0
    read = expanded(F.col("text")) if transliterated else canonical(F.col("text"))
    held = spread(texts.select("id", read.alias("read")).filter("read != ''"))
    blocks, out = max(1, math.ceil(letters / LETTERS)), None
    for b in range(blocks):
        rows = forms.filter(F.pmod(F.xxhash64("form"), F.lit(blocks)) == b).collect()
        known = texts.sparkSession.sparkContext.broadcast([(k, list(r["variants"])) for k, r in enumerate(rows)])

        table = texts.sparkSession.createDataFrame([(k, *r[:6]) for k, r in enumerate(rows)], "number int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in forms.schema.fields[:6]))
        hits = held.select("id", F.explode(F.pandas_udf(_finder(known), "array<int>")("read")).alias("number")).distinct().join(F.broadcast(table), "number").drop("number")
        out = hits if out is None else out.unionByName(hits)
    return out
