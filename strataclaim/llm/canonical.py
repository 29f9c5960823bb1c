"""Problem 3: freely entered values mapped to the closest entry of a reference list.

The list's names and aliases go into a symmetric-delete dictionary: every form is stored under itself
and under all its strings with up to two characters deleted, so a value's own deletions meet every
form within two edits without comparing it to the list. Candidates are ranked by weighted
Damerau-Levenshtein distance, then by the entry's frequency, then by the smaller id.

Dress is taken off first: letter case, marks, accents, look-alike letters of other scripts, joined
words, the order of words, qualifying words around a name, plurals, and words cut short. A value that
joins words of listed names into one that isn't listed means none of them: it is nearer to that join
than to any entry. What is left without an entry is reported with id 0.

Values are counted, distinct ones resolved once, and rows joined with what their value means; frequent
values meet it by a broadcast. The dictionary is broadcast; a list over ``MAX_ENTRIES`` entries is worked
off in blocks of that many, each broadcast in turn, and the best of all blocks is taken.

A null value gives no row, a blank one the id 0, and so does one that is the name of no entry,
whatever its length. Entries without names and broken lists of aliases are passed over. Repeated rows
each get their rows. Extra columns are left out.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataclaim.session import broadcast_checked, write_cut

MAX_ENTRIES = 20_000
MAX_EDITS = 2
#: A value is hot with more than a ``HOT_SHARE``-th of all rows.
HOT_SHARE = 1_000
#: Shorter forms (abbreviations, mostly) are met only as they are spelt: an edit makes another one of them.
MIN_FUZZY = 6
#: Longer forms aren't stored under their deletions, whose number grows as the square of the length, but
#: under ``SEGMENTS`` segments: ``MAX_EDITS`` edits, swaps across a border among them, leave one of them whole.
LONG, SEGMENTS = 40, 2 * MAX_EDITS + 1

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнгпАВЕКМНОРСТУХІЈЅοανρτυικεχωηΑΒΕΖΗΙΚΜΝΟΡΤΥΧıøłđ", "aeopcyxijsdhkmtbhrnABEKMHOPCTYXIJSoavptuikexwnABEZHIKMNOPTYXiold")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_BRACKETS = regex.compile(r"\[[^\]]*\]|\{[^}]*\}")

#: Words that qualify a name without changing what it names (fixed lists).
BEFORE = tuple(
    tuple(x.split())
    for x in "the|a|an|so called|increased|decreased|increasing|decreasing|reduced|reducing|higher|lower|high|low|elevated|improved|impaired|enhanced|altered|overall|total|mean|average|median|general|relative|net|degree of|level of|levels of|rate of|amount of|extent of|effect of|effects of|change in|changes in|loss of|lack of|presence of|measure of|measures of|process of|role of|impact of|our|their|its|this|that|these|such|observed|reported|measured|e g|i e|ca|about|more|less|greater|strong|weak|human".split("|")
)
AFTER = tuple(
    tuple(x.split())
    for x in "level|levels|effect|effects|process|processes|mean|average|median|rate|rates|score|scores|index|value|values|in vitro|in vivo|in silico|ex vivo|see text|see table|see below|ref|sic|et al|measure|measures|response|outcome|outcomes|change|changes|baseline|group|data|overall|total|only|etc|observed|measured|itself|etc".split("|")
)
_BEFORE, _AFTER = frozenset(BEFORE), frozenset(AFTER)
#: Marks of words in another order, and of words cut short.
_TURNED = regex.compile(r"[,/()]|\b(?:that|which) (?:is|are)\b|\bof\b", regex.I)
_CUT = regex.compile(r"\p{L}(?:\.{1,3}|…|-\s*$)")
_JOINERS = frozenset("that is which are of being the".split())


_INVISIBLE = regex.compile(r"\p{Cf}+")
#: Of ASCII, all that is neither letter nor digit becomes a blank.
_PLAIN = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def plain(value: str) -> str:
    """Lower case, Latin look-alikes, no accents; letters, digits and single blanks."""
    if value.isascii():
        v = _CAMEL.sub(" ", value) if not value.isupper() and " " not in value.strip() else value
        return " ".join(v.translate(_PLAIN).split())
    v = unicodedata.normalize("NFKC", value).translate(_LOOKALIKES)
    v = _CAMEL.sub(" ", v) if not v.isupper() and " " not in v.strip() else v
    v = "".join(c for c in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(c))
    return " ".join(_TOKEN.findall(_INVISIBLE.sub("", v)))


def deletions(word: str, most: int) -> set[str]:
    """A string and all that remain of it when up to ``most`` characters (one or two) are deleted."""
    n = len(word)
    out = {word}
    if most:
        out.update([word[:k] + word[k + 1 :] for k in range(n)])
    if most > 1:
        for k in range(n):
            head = word[:k]
            out.update([head + word[k + 1 : m] + word[m + 1 :] for m in range(k + 1, n)])
    return out


_VOWELS = frozenset("aeiouy")


def weighted_distance(a: str, b: str, most: float = 3.0) -> float:
    """Damerau-Levenshtein distance (adjacent swaps) with weights; ``inf`` beyond ``most``.

    A swap costs 0.9, a doubled or undoubled letter 0.6, a vowel for a vowel 0.8, a doubt in the first
    letter 0.2 more, all else 1. As a step off the diagonal costs 0.6 at least, only a band around it is
    worked out, so the cost grows with the length alone.
    """
    inf, band = float("inf"), int(most / 0.6 + 1e-9)
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return inf
    two: list[float] = []
    one = [inf] * (m + 1)
    one[0] = 0.0
    for j in range(1, min(m, band) + 1):
        one[j] = one[j - 1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0)
    for i in range(1, n + 1):
        x = a[i - 1]
        drop = 0.6 if i > 1 and x == a[i - 2] else 1.0
        now = [inf] * (m + 1)
        from_, to = max(1, i - band), min(m, i + band)
        if i <= band:
            now[0] = one[0] + drop
        low = now[0]
        for j in range(from_, to + 1):
            y = b[j - 1]
            if x == y:
                best = one[j - 1]
            else:
                best = one[j - 1] + (0.8 if x in _VOWELS and y in _VOWELS else 1.0) + (0.2 if i == 1 or j == 1 else 0.0)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and two[j - 2] + 0.9 < best:
                    best = two[j - 2] + 0.9
            if one[j] + drop < best:
                best = one[j] + drop
            add = now[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 1.0)
            if add < best:
                best = add
            now[j] = best
            if best < low:
                low = best
        if low > most:
            return inf
        two, one = one, now
    return one[-1] if one[-1] <= most else inf


def _singular(token: str) -> str:
    if token.endswith("ies") and len(token) > 4:
        return token[:-3] + "y"
    return token[:-1] if token.endswith("s") and not token.endswith("ss") and len(token) > 3 else token


def _segments(n: int) -> list[tuple[int, int]]:
    """Places of the segments of a form of ``n`` letters."""
    return [(k * n // SEGMENTS, (k + 1) * n // SEGMENTS) for k in range(SEGMENTS)]


@dataclass(frozen=True)
class Entry:
    """An entry of the reference list."""

    id: int
    name: str
    aliases: tuple[str, ...]
    frequency: float


class Matcher:
    """Symmetric-delete dictionary of a block of entries, with the words of the whole list."""

    MEMORY = 200_000

    def __init__(self, entries: list[Entry], vocabulary: frozenset[str]):
        self.rank = {e.id: (-e.frequency, e.id) for e in entries}
        self.forms: dict[str, int] = {}
        self.tokens: list[tuple[tuple[str, ...], int]] = []
        by_count: dict[int, list[int]] = defaultdict(list)
        bags: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for e in sorted(entries, key=lambda e: self.rank[e.id]):
            for form in (e.name, *e.aliases):
                p = plain(form)
                if not p:
                    continue
                self.forms.setdefault(p.replace(" ", ""), e.id)
                ts = tuple(p.split())
                if len(p) >= 6 or len(ts) > 1:
                    by_count[len(ts)].append(len(self.tokens))
                    self.tokens.append((ts, e.id))
                    bags[tuple(sorted(ts))].append(e.id)
        self.bags = {k: v[0] for k, v in bags.items()}
        self.by_first: dict[str, list[int]] = defaultdict(list)
        for k, (ts, _) in enumerate(self.tokens):
            self.by_first[ts[0][:3]].append(k)
        self.deletes: dict[str, tuple[str, ...]] = {}
        found: dict[str, list[str]] = defaultdict(list)
        #: (length, segment's number, its letters) of long forms
        self.segments: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for form in self.forms:
            if MIN_FUZZY <= len(form) <= LONG:
                for d in deletions(form, MAX_EDITS):
                    found[d].append(form)
            elif len(form) > LONG:
                for k, (low, high) in enumerate(_segments(len(form))):
                    self.segments[len(form), k, form[low:high]].append(form)
        self.deletes = {k: tuple(v) for k, v in found.items()}
        self.stored = frozenset(self.deletes)
        #: lengths that values near to a form can have
        self.lengths = {len(f) + d for f in self.forms if len(f) >= MIN_FUZZY for d in range(-MAX_EDITS, MAX_EDITS + 1)}
        self.long_lengths = {n for n, _, _ in self.segments}
        self.vocabulary, self.longest = vocabulary, max(map(len, vocabulary), default=0)
        words: dict[str, list[str]] = defaultdict(list)
        for w in vocabulary:
            for d in deletions(w, MAX_EDITS if len(w) > 5 else 1):
                words[d].append(w)
        self.words = {k: tuple(v) for k, v in words.items()}
        self.memory: dict[str, tuple[int, float]] = {}
        self.near_words: dict[str, tuple[str | None, float]] = {}

    def __call__(self, value: str) -> tuple[int, float]:
        """(id, cost) of the entry a value means; (0, inf) if it means none."""
        if (hit := self.memory.get(value)) is None:
            if len(self.memory) >= self.MEMORY:
                self.memory.clear()
            hit = self.memory[value] = self.resolve(value)
        return hit

    def readings(self, value: str) -> list[tuple[str, ...]]:
        """The words of a value, as entered and without qualifying words, the plainest first."""
        base = tuple(plain(value).split())
        bare = tuple(plain(_BRACKETS.sub(" ", value)).split()) or base
        out = [base]
        if bare != base:
            out.append(bare)
        for ts in list(out):
            while True:
                # no qualifier begins or ends with another one
                k = next((n for n in (1, 2) if len(ts) > n and ts[:n] in _BEFORE), 0)
                if k:
                    ts = ts[k:]
                elif k := next((n for n in (1, 2) if len(ts) > n and ts[-n:] in _AFTER), 0):
                    ts = ts[:-k]
                else:
                    break
                if ts not in out:
                    out.append(ts)
        return out

    def resolve(self, value: str) -> tuple[int, float]:
        readings = [r for r in self.readings(value) if r]
        # 1. the same letters: as entered, reordered, singular
        for cost, ts in enumerate(readings):
            if (i := self.forms.get("".join(ts))) is not None:
                return i, 0.1 * cost
        for cost, ts in enumerate(readings):
            if len(ts) > 1:
                kept = [t for t in ts if t not in _JOINERS]
                if (i := self.bags.get(tuple(sorted(kept)))) is not None:
                    return i, 0.2 + 0.1 * cost
            if (i := self.forms.get("".join((*ts[:-1], _singular(ts[-1]))))) is not None:
                return i, 0.3 + 0.1 * cost
        if not readings:
            return 0, float("inf")
        # a join of listed words that isn't listed, and isn't cut or turned round, is nearer than any entry
        if any(len(ts) > 1 and all(t in self.vocabulary for t in ts) for ts in readings) and not _TURNED.search(value) and not _CUT.search(value):
            return 0, float("inf")
        # 2. words cut short
        cut = self.cut_short(value, readings)
        if cut:
            return cut, 0.5
        # 3. misspelt, unless nearer to a join of listed words that isn't listed
        best: tuple[float, tuple[float, int], int] | None = None
        for cost, ts in enumerate(readings):
            for order in self.orders(ts, value):
                for form, d in self.near("".join(order)):
                    i = self.forms[form]
                    key = (d + 0.1 * cost, self.rank[i], i)
                    if best is None or key < best:
                        if self.join_distance(order) < d - 1e-9 and form != "".join(self.joined(order) or ()):
                            continue
                        best = key
        if best:
            return best[2], best[0]
        # 4. every word misspelt within its own bound
        for cost, ts in enumerate(readings):
            for order in self.orders(ts, value):
                if (near := self.joined(order)) and (i := self.forms.get("".join(near))) is not None:
                    return i, self.join_distance(order) + 0.1 * cost
        return 0, float("inf")

    def orders(self, ts: tuple[str, ...], value: str) -> Iterator[tuple[str, ...]]:
        """A value's words as entered, and turned round at any word (``b, a`` for ``a b``) if marked so."""
        yield ts
        if not _TURNED.search(value):
            return
        kept = tuple(t for t in ts if t not in _JOINERS)
        # turned round, it has as many letters and words as before
        if sum(map(len, kept)) in self.lengths:
            for k in range(1, len(kept)):
                yield kept[k:] + kept[:k]

    def near(self, text: str) -> list[tuple[str, float]]:
        """Forms within the bound, with their weighted distances."""
        if len(text) not in self.lengths:
            return []
        most = MAX_EDITS if len(text) > 7 else 1
        seen: set[str] = set()
        if len(text) <= LONG + MAX_EDITS:
            seen.update(itertools.chain.from_iterable(map(self.deletes.__getitem__, deletions(text, most) & self.stored)))
        if len(text) > LONG - MAX_EDITS and self.segments:
            for n in range(len(text) - MAX_EDITS, len(text) + MAX_EDITS + 1):
                for k, (low, high) in enumerate(_segments(n) if n in self.long_lengths else ()):
                    for d in range(-MAX_EDITS, MAX_EDITS + 1):
                        if low + d >= 0:
                            seen.update(self.segments.get((n, k, text[low + d : high + d]), ()))
        return [(f, d) for f in seen if (d := weighted_distance(text, f, 3.05 if len(text) > 11 else most + 0.25)) < float("inf")]

    def word_near(self, token: str) -> tuple[str | None, float]:
        if token in self.vocabulary:
            return token, 0.0
        if (hit := self.near_words.get(token)) is None:
            if len(self.near_words) >= self.MEMORY:
                self.near_words.clear()
            hit = self.near_words[token] = self.find_word(token)
        return hit

    def find_word(self, token: str) -> tuple[str | None, float]:
        # a longer token than any listed word and its edits is near none
        if len(token) > self.longest + MAX_EDITS:
            return None, float("inf")
        seen = set(itertools.chain.from_iterable(self.words.get(d, ()) for d in deletions(token, MAX_EDITS if len(token) > 5 else 1)))
        return min(((w, weighted_distance(token, w, 2.25)) for w in sorted(seen)), key=lambda x: x[1], default=(None, float("inf")))

    def joined(self, ts: tuple[str, ...]) -> tuple[str, ...] | None:
        near = []
        for t in ts:
            if (w := self.word_near(t)[0]) is None:
                return None
            near.append(w)
        return tuple(near)

    def join_distance(self, ts: tuple[str, ...]) -> float:
        """Distance to the nearest sequence of listed words, whether a name or not."""
        total = 0.0
        for t in ts:
            if (total := total + self.word_near(t)[1]) == float("inf"):
                break
        return total

    def cut_short(self, value: str, readings: list[tuple[str, ...]]) -> int | None:
        """The entry whose words begin with the value's words, where the value is marked or ends as cut."""
        marked = bool(_CUT.search(value))
        for ts in readings:
            if len(ts) < 2 or sum(map(len, ts)) < 7 or len(ts[0]) < 3:
                continue
            found = []
            for k in self.by_first.get(ts[0][:3], ()):
                name, i = self.tokens[k]
                if len(ts) > len(name) or len(ts) < len(name) and not marked:
                    continue
                short = [len(n) - len(t) for t, n in zip(ts, name) if n != t]
                if all(n.startswith(t) and (n == t or len(t) >= 2) for t, n in zip(ts, name)) and (short or len(ts) < len(name)):
                    # a word listed itself isn't taken for the beginning of another, unless marked
                    if not marked and any(n != t and t in self.vocabulary for t, n in zip(ts, name)):
                        continue
                    found.append((self.rank[i], i))
            if found:
                return min(found)[1]
        return None


def reference_entries(rows: list) -> list[Entry]:
    """Entries from rows of (id, name, aliases as a JSON array, frequency)."""
    out = []
    for i, name, aliases, frequency in rows:
        try:
            listed = json.loads(aliases) if aliases else []
        except ValueError:
            listed = []
        out.append(Entry(i, name or "", tuple(a for a in listed if isinstance(a, str)) if isinstance(listed, list) else (), float(frequency or 0)))
    return out


_MATCHERS: dict[tuple, Matcher] = {}


def _match(shared, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (shared.id if hasattr(shared, "id") else id(shared), number)
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(*shared.value)
        m = _MATCHERS[key]
        for b in batches:
            found = [m(v) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([i for i, _ in found], pa.int64()), pa.array([c for _, c in found], pa.float64()), pa.array([-m.rank[i][0] if i else 0.0 for i, _ in found], pa.float64())],
                names=["value", "n", "concept_id", "cost", "frequency"],
            )

    return run


def resolve_values(counted: DataFrame, reference: DataFrame, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``(value, n, concept_id, cost)`` of distinct ``(value, n)``, from a reference of (id, name, aliases, frequency)."""
    spark = counted.sparkSession
    blocks = max(1, -(-reference.count() // max_entries))
    # by number: the work is in the values, not in their bytes
    counted = counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("value"))
    if blocks > 1:
        counted = write_cut(counted)
    # the words of the list's names, of which there are at most a few a name
    vocabulary = frozenset(w for r in reference.select("name").toLocalIterator() for w in plain(r.name or "").split())
    parts = []
    for k in range(blocks):
        rows = reference.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast((reference_entries(rows), vocabulary))
        parts.append(counted.mapInArrow(_match(shared, k), "value string, n bigint, concept_id bigint, cost double, frequency double"))
    if blocks == 1:
        return parts[0].select("value", "n", "concept_id", "cost")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.min(F.struct("cost", (-F.col("frequency")).alias("f"), F.when(F.col("concept_id") == 0, F.lit(2**62)).otherwise(F.col("concept_id")).alias("i"), "concept_id")).alias("b")
    return out.groupBy("value", "n").agg(best).select("value", "n", F.col("b.concept_id").alias("concept_id"), F.col("b.cost").alias("cost"))


def map_values(values: DataFrame, reference: DataFrame, id_col: str, name_col: str, aliases_col: str, frequency_col: str, max_entries: int = MAX_ENTRIES, hot_share: int = HOT_SHARE) -> DataFrame:
    """``(tab, row_id, field, concept_id, cost)`` for ``values`` of (tab, row_id, field, value).

    Values that are null or, letter for letter, a name of the list are left out. Every distinct value is
    resolved once. Values that make up over a ``hot_share``-th of all rows (found exactly from partial
    counts; there are at most ``hot_share`` of them) meet their entries by a broadcast, the rest by a join
    on the value, broadcast too if few.
    """
    ref = reference.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name"), F.col(aliases_col).alias("aliases"), F.col(frequency_col).cast("double").alias("frequency"))
    names = ref.select(F.col("name").alias("value")).where("value is not null").distinct()
    rows = values.select("tab", F.col("row_id").cast("long").alias("row_id"), "field", "value").where("value is not null")
    counted = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).join(broadcast_checked(names)[0], "value", "left_anti")
    resolved = write_cut(resolve_values(counted, ref, max_entries))
    side, small = broadcast_checked(resolved.select("value", "concept_id", "cost"))
    columns = ("tab", "row_id", "field", "concept_id", "cost")
    if small:
        return rows.join(side, "value").select(*columns)
    total = resolved.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(resolved.where(F.col("n") > total / hot_share).select("value", "concept_id", "cost"))
    cold = resolved.where(F.col("n") <= total / hot_share).select("value", "concept_id", "cost")
    return rows.join(hot, "value").select(*columns).unionByName(rows.join(hot, "value", "left_anti").join(cold, "value").select(*columns))
