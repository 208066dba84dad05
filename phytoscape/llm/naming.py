"""Mapping freely typed names to a canonical list.

The forms of every entry (name, synonym, vernacular, short code) go into a
symmetric-delete dictionary: all strings that arise by leaving out characters
point back to the form, so a typed name finds its candidates by leaving out
characters itself, without a comparison to the whole list. Candidates are
ranked by a weighted Damerau-Levenshtein distance (characters that look or
sound alike cost half) and then by how often the entry is named without doubt.
Typed values are made different before they are matched. A list too long for
one task is cut into several dictionaries, each of which ranks its own
candidates; the best of all is kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phytoscape.session import materialise

#: Entries of the reference list that one dictionary holds; longer lists are looked up in several.
MOST_ENTRIES = 200_000
#: Different names up to which their entries are broadcast to the records; more are joined by shuffle.
BROADCAST_NAMES = 500_000

# fixed values: what is disregarded in names, placeholders, and characters that look or sound alike
_QUALIFIERS = {"cf", "aff", "x", "×", "ex", "hybrid"}
_RANKS = {"var", "subsp", "ssp", "f", "forma", "fo", "subvar", "cv", "variety"}
_NO_EPITHET = {"sp", "spp", "species", "indet", "unknown", "undet", "spec", "seedling", "unidentified"}
_ALIKE = {frozenset(p) for p in ("0o", "1l", "1i", "il", "yi", "ck", "kq", "cq", "sz", "5s", "uv", "ae", "ei", "8b", "vw", "ou", "dt", "mn")}


def fold(text: str) -> str:
    """Lower case without accents; blanks, underscores and hyphens become single blanks."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return re.sub(r"[\s_\-‐-―]+", " ", text).strip(" .;,\"'")


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance (neighbours swapped cost 1); above ``most`` any value above it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            sub = 0.0 if x == y else 0.5 if frozenset((x, y)) in _ALIKE else 1.0
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + sub)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most and min(last) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def _deletes(s: str, n: int) -> set[str]:
    out = {s}
    for k in range(1, min(n, len(s) - 1) + 1):
        out.update("".join(c for i, c in enumerate(s) if i not in gone) for gone in map(set, combinations(range(len(s)), k)))
    return out


class Dictionary:
    """Forms of the reference entries: (id, name, code, synonym, vernacular), any but id and name may be missing.

    Candidates are tuples (rule, distance, reading, kind of form, −records that
    name the entry, entry); the smallest is meant.
    """

    def __init__(self, entries: list[tuple], named: dict[int, int] | None = None):
        self.named = named or {}
        self.whole: dict[str, set[tuple[int, int]]] = defaultdict(set)
        self.pairs: dict[tuple[str, str], set[tuple[int, int]]] = defaultdict(set)
        self.short: dict[tuple[str, str], set[tuple[int, int]]] = defaultdict(set)
        self.tokens: dict[str, set[str]] = defaultdict(set)
        self.glued: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.longest = 0
        for ref, name, code, synonym, vernacular in entries:
            for kind, form in enumerate((name, synonym)):
                t = fold(form or "").split(" ")
                if len(t) < 2:
                    continue
                genus, epithet = t[0], "".join(t[1:])
                self.pairs[genus, epithet].add((kind, ref))
                self.whole[genus + epithet].add((kind, ref))
                if not kind:
                    for n in range(1, min(len(genus), 4)):
                        self.short[genus[:n], epithet].add((kind, ref))
                self.longest = max(self.longest, len(genus) + len(epithet))
                for w in (genus, epithet):
                    for d in _deletes(w, 1):
                        self.tokens[d].add(w)
                for d in _deletes(genus + epithet, 2):
                    self.glued[d].add((genus, epithet))
            for kind, form in ((2, code), (3, vernacular)):
                if form and fold(form):
                    self.whole[fold(form).replace(" ", "")].add((kind, ref))

    def _ranked(self, rule: int, distance: float, reading: int, forms) -> list[tuple]:
        return [(rule, distance, reading, kind, -self.named.get(ref, 0), ref) for kind, ref in forms]

    def _near(self, word: str) -> dict[str, float]:
        """Known words at most one slip away (alike characters allow two); a single character is no word."""
        if not 1 < len(word) <= self.longest + 2:  # farther from every form than any slip allows
            return {}
        found = set().union(*(self.tokens.get(d, ()) for d in _deletes(word, 1)))
        return {w: d for w in found if (d := weighted_distance(word, w, 1.0)) <= 1.0}

    def _binomial(self, rule: int, genus: str, epithets: list[str]) -> list[tuple]:
        exact = [c for k, e in enumerate(epithets) for c in self._ranked(rule, 0.0, k, self.pairs.get((genus, e), ()))]
        if exact:
            return exact
        near = self._near(genus)
        return [c for k, e in enumerate(epithets) for w, d in self._near(e).items() for n, g in near.items() for c in self._ranked(rule, d + g, k, self.pairs.get((n, w), ()))]

    def _initial(self, rule: int, letters: str, epithets: list[str]) -> list[tuple]:
        exact = [c for k, e in enumerate(epithets) for c in self._ranked(rule, 0.0, k, self.short.get((letters, e), ()))]
        return exact or [c for k, e in enumerate(epithets) for w, d in self._near(e).items() for c in self._ranked(rule, d, k, self.short.get((letters, w), ()))]

    def _glued(self, rule: int, word: str, reading: int = 0) -> list[tuple]:
        """A name without blank: candidates two characters away, at most one slip in either part."""
        if not 1 < len(word) <= self.longest + 2:
            return []
        found = []
        for genus, epithet in set().union(*(self.glued.get(d, ()) for d in _deletes(word, 2))):
            parts = [(weighted_distance(word[:n], genus, 1.0), weighted_distance(word[n:], epithet, 1.0)) for n in range(max(1, len(genus) - 1), min(len(word), len(genus) + 2))]
            best = min((a + b for a, b in parts if a <= 1 and b <= 1), default=None)
            if best is not None:
                found += self._ranked(rule, best, reading, self.pairs[genus, epithet])
        return found

    def match(self, typed: str) -> tuple | None:
        """The best candidate for a typed name, None if it fits no entry. Rules are tried in order, the first that finds any decides."""
        text = fold(typed)
        if not text:
            return None
        found = self._ranked(0, 0.0, 0, self.whole.get(text.replace(" ", ""), ()))
        turned = re.match(r"^([a-z ]+?)\s*\(\s*([a-z]+)\s*\)$", text) or re.match(r"^([a-z0-9 ]+?)\s*,\s*([a-z0-9]+)$", text)
        if turned and not found:
            found = self._binomial(1, turned[2], [turned[1].replace(" ", ""), turned[1].split(" ")[0]])
        if found:
            return min(found)
        raw = [t for t in re.split(r"[\s,;()]+", text) if t]
        kept = [(t.lstrip("×").strip("."), t.endswith(".")) for t in raw]
        kept = [(t, dot) for t, dot in kept if t and t not in _QUALIFIERS]
        rank = next((i for i, (t, _) in enumerate(kept) if i >= 2 and t in _RANKS), len(kept))
        words = [t for t, _ in kept[:rank]]
        if len(words) < 2:
            return min(self._glued(2, words[0]), default=None) if words else None
        if words[1] in _NO_EPITHET or not re.match(r"^[a-z0-9]+$", words[1]):
            return None
        epithets = ["".join(words[1:3]), words[1]] if len(words) > 2 else [words[1]]
        if len(words[0]) == 1:
            return min(self._initial(2, words[0], epithets), default=None)
        found = self._binomial(2, words[0], epithets)
        if not found and kept[0][1] and len(words[0]) < 4:
            found = self._initial(3, words[0], epithets)
        return min(found or self._glued(4, "".join(words[:2])) or self._glued(5, words[0]), default=None)

    def lookup(self, typed: str) -> int:
        """The entry meant, 0 if none is."""
        best = self.match(typed)
        return best[-1] if best else 0


def map_names(records: DataFrame, reference: DataFrame, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(table_name, record_id, species, ref_id) for every distinct record (table_name, record_id, species) that needs mapping.

    reference: (ref_id, species, short_code, synonym, vernacular). Records with
    NULL or blank names, and names that are exactly an entry, need none;
    repeated records count once; ref_id 0 reports a name that fits no entry.
    Ties go to names before synonyms, codes and vernaculars, then to the entry
    named most often, then to the smallest id. Lists of more than
    ``most_entries`` entries are looked up in several dictionaries, each by all
    different names, and the best candidate of all is kept. An empty list maps
    everything to 0.
    """
    usable = reference.where("ref_id is not null and species is not null").select(F.col("ref_id").cast("int").alias("ref_id"), "species", "short_code", "synonym", "vernacular")
    size = usable.count()
    spark = records.sparkSession
    used = records.where("species is not null").groupBy("species").agg(F.count("*").alias("n"))
    exact = usable.groupBy("species").agg(F.min("ref_id").alias("ref_id"))
    few = lambda df: F.broadcast(df) if size <= most_entries else df
    named = used.join(few(exact), "species").groupBy("ref_id").agg(F.sum("n").alias("n"))
    open_ = used.select("species").where(r"not species rlike '^\\s*$'").join(few(exact.select("species")), "species", "left_anti")
    shards = max(1, -(-size // most_entries))
    if shards > 1:
        open_, named = materialise(open_), materialise(named)
    parts = []
    for shard in range(shards):
        own = usable.where(F.pmod(F.xxhash64("ref_id"), F.lit(shards)) == shard)
        entries = [tuple(r) for r in own.collect()]  # about most_entries
        counts = {r["ref_id"]: r["n"] for r in named.join(own.select("ref_id").distinct(), "ref_id", "left_semi").collect()}  # a row per entry
        shared = spark.sparkContext.broadcast((entries, counts))

        def go(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = None
            for b in batches:
                known = known or Dictionary(*shared.value)
                found = [known.match(s) or (99, 0.0, 0, 0, 0, 0) for s in b["species"]]
                yield pd.DataFrame({"species": b["species"], "rule": [f[0] for f in found], "distance": [float(f[1]) for f in found], "reading": [f[2] for f in found], "kind": [f[3] for f in found], "fewer": [f[4] for f in found], "ref_id": [f[5] for f in found]})

        parts.append(open_.mapInPandas(go, "species string, rule int, distance double, reading int, kind int, fewer long, ref_id int"))
    if shards > 1:
        best = parts[0]
        for p in parts[1:]:
            best = best.union(p)
        mapped = best.groupBy("species").agg(F.min(F.struct("rule", "distance", "reading", "kind", "fewer", "ref_id")).alias("b")).select("species", F.col("b.ref_id").alias("ref_id"))
    else:
        mapped = parts[0].select("species", "ref_id")
    mapped = materialise(mapped)
    if mapped.count() <= BROADCAST_NAMES:  # names are skewed in the records: no shuffle by name while they fit
        mapped = F.broadcast(mapped)
    return records.select("table_name", "record_id", "species").distinct().join(mapped, "species").select("table_name", "record_id", "species", "ref_id")
