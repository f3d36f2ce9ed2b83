"""Places of a large vocabulary in prose: names from a table, a trie of them broadcast in blocks of a bounded size.

A trie finds the longest name at a place in time linear in that name, whatever the
vocabulary holds. The table is read in blocks of at most BLOCK_LETTERS letters; each
block takes a pass over the texts and keeps what it finds beside them, so a larger
vocabulary takes more passes, never a larger broadcast, and blocks change no result.
Nulls and empty texts name no place. Empty names are skipped, repeated ones count once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.pages import _each

#: A trie of so many letters takes some 100 MB at most.
BLOCK_LETTERS = 400_000
HEBREW = r"[֐-׿]"
# Words with which prose gives a place away, names that are words first, abbreviations of towns.
CUE = r"(?:\p{Extended_Pictographic}|מיקום|כתובת|סניף|פארק(?:\s+המדע)?|משרדי(?:נו)?|ממוקמ[A-Za-z0-9_]*|עיר|אתר)"
DIRECTION = r"(?:אזור(?:\s+ה?תעשיי?ה)?|מרחב|צפון|דרום|מרכז|מזרח|מערב)"
NEVER = {"מלאה"}
NOT_BARE = {"משמרות", "אזור"}
LEAST_BARE = 4
SHORT = {'ראשל"צ': "ראשון לציון", 'ת"א': "תל אביב-יפו", 'ב"ש': "באר שבע", 'פ"ת': "פתח תקווה", 'ר"ג': "רמת גן", 'כ"ס': "כפר סבא", "י-ם": "ירושלים"}
WINDOW = 30


class Trie:
    """Names by their letters."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        for name in names:
            node = self.root
            for letter in name:
                node = node.setdefault(letter, {})
            node[""] = True

    def ends(self, text: str, at: int) -> list[int]:
        """Where the names that start at a place end, the longest first."""
        node, out, i = self.root, [], at
        while node is not None:
            if "" in node:
                out.append(i)
            node = node.get(text[i]) if i < len(text) else None
            i += 1
        return out[::-1]


def blocks(vocabulary: DataFrame, *columns: str) -> Iterator[list[tuple]]:
    """The vocabulary's rows in blocks of a bounded number of letters, at least one block; the names are the first column."""
    block, letters = [], 0
    for row in vocabulary.select(*columns).where(F.length(columns[0]) > 0).distinct().toLocalIterator():
        if block and letters + len(row[0]) > BLOCK_LETTERS:
            yield block
            block, letters = [], 0
        block.append(tuple(row))
        letters += len(row[0])
    yield block


def _passes(df: DataFrame, text: str, kind: str, makers: Iterator[Callable[[str], object]]) -> DataFrame:
    """The table with an array column `_found` of what each block finds in a text."""
    out = df.withColumn("_found", F.array().cast(f"array<{kind}>"))
    for find in makers:
        out = out.withColumn("_found", F.concat("_found", _each(find, f"array<{kind}>", F.coalesce(F.col(text), F.lit("")))))
    return out


def _hits(trie: Trie, letter: re.Pattern, before: re.Pattern) -> Callable[[str], list[dict]]:
    def find(text: str) -> list[dict]:
        out = []
        for i, c in enumerate(text):
            if c in trie.root and not before.search(text, max(i - 2, 0), i):
                end = next((e for e in trie.ends(text, i) if e == len(text) or not letter.match(text[e])), None)
                if end is not None:
                    out.append({"start": i, "end": end, "name": text[i:end]})
        return out

    return find


def scan(df: DataFrame, text: str, vocabulary: DataFrame, name: str = "name", out: str = "places", letter: str = HEBREW, joined: str = "ו") -> DataFrame:
    """The names in a text from left to right, the longest at each place, none inside another; each once.

    letter: what a name may not be glued to, on either side; joined: a letter that may stand before a name at the start of a word.
    """
    bound = re.compile(letter)
    before = re.compile(rf"(?:(?!{joined}){letter}|{letter}{letter})$" if joined else rf"{letter}$")
    makers = (_hits(Trie([n for (n,) in block]), bound, before) for block in blocks(vocabulary, name))
    found = _passes(df, text, "struct<start:int,end:int,name:string>", makers)
    # Of names that start at one place the longest is first; one that starts before the last one's end is passed over.
    ordered = F.array_sort(F.transform("_found", lambda h: F.struct(h["start"].alias("start"), (-h["end"]).alias("end"), h["name"].alias("name"))))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("names"))
    step = lambda s, h: F.when(h["start"] >= s["free"], F.struct((-h["end"]).alias("free"), F.concat(s["names"], F.array(h["name"])).alias("names"))).otherwise(s)
    return found.withColumn(out, F.array_distinct(F.aggregate(ordered, start, step, lambda s: s["names"]))).drop("_found")


class Prose:
    """The eight ways in which prose names a place, from the surest to the coarsest."""

    def __init__(self, cities: list[str], regions: list[str]):
        cities, regions = ([n for n in names if n not in NEVER] for names in (cities, regions))
        bare = lambda names: Trie([n for n in names if len(n) >= LEAST_BARE and n not in NOT_BARE])
        short = Trie([s.replace('"', q) for s in SHORT for q in '"״'])
        town, area, sure = Trie(cities), Trie(regions), bare(cities)
        free = rf"(?<!{HEBREW})"
        self.ways = [
            (r"(?:ל?אזור|בעיר)\s+", [area], True), (r"(?:ל?אזור|בעיר|במשרדי?(?:\s+ה[A-Za-z0-9_]+)?\s+ב)\s*", [town], True), (None, [town], True), (rf"{free}ב{DIRECTION}\s+", [short, town], True),
            (rf"{free}ב", [short], False), (rf"{free}ב", [sure], True), (rf"{free}ב", [bare(regions)], True), (rf"{free}ל[א-ת]{{2,}}\s+", [sure], True),
        ]
        self.ways = [(p and regex.compile(p), tries, bound) for p, tries, bound in self.ways]
        self.cue, self.letter = regex.compile(CUE), re.compile(HEBREW)

    def at(self, text: str, i: int, tries: list[Trie], bound: bool) -> int | None:
        """Where the name at a place ends: of the first trie that has one, the longest that isn't glued to a letter."""
        return next((e for t in tries for e in t.ends(text, i) if not bound or e == len(text) or not self.letter.match(text[e])), None)

    def find(self, text: str) -> list[dict]:
        """The way, where it starts, where the name starts, less its length, and the name; of all the least one, if there is one."""
        for way, (pattern, tries, bound) in enumerate(self.ways):
            m = (pattern or self.cue).search(text)
            while m:
                last = m.end() if pattern else min(m.end() + WINDOW, len(text))
                for i in range(m.end(), last + 1):
                    if not pattern and i and self.letter.match(text[i - 1]):
                        continue
                    if (end := self.at(text, i, tries, bound)) is not None:
                        name = text[i:end]
                        return [{"way": way, "start": m.start(), "at": i, "less": i - end, "name": SHORT.get(name.replace("״", '"'), name)}]
                m = (pattern or self.cue).search(text, m.start() + 1)
        return []


def from_prose(df: DataFrame, text: str, vocabulary: DataFrame, name: str = "name", kind: str = "kind", out: str = "place") -> DataFrame:
    """The first place that prose names without a label; null without one. kind: `region`, anything else is a town.

    A region, then a town after its noun or office; a town within 30 letters after a cue (a
    pictograph or a noun); a town after a direction; an abbreviation, a town, a region
    after the preposition; a town after a workplace. Names of under four letters and
    names that are words first count only with a noun, a direction or a cue.
    """
    makers = (Prose([n for n, k in block if k != "region"], [n for n, k in block if k == "region"]).find for block in blocks(vocabulary, name, kind))
    found = _passes(df, text, "struct<way:int,start:int,at:int,less:int,name:string>", makers)
    return found.withColumn(out, F.array_min("_found")["name"]).drop("_found")
