"""Problem 6: lines repeated across one source's documents, found by token trees and removed.

1. *Trees.* Each partition parses its lines into trees of a fixed depth, one a source: the first level
   goes by the number of tokens, the next ``DEPTH`` levels by the first tokens, and a leaf holds the
   templates of its lines. A token is what stands between blanks, by its letters in lower case; one
   without letters (a number, a date, a mark) is a wildcard slot, written ``<*>``, and neighbouring slots
   are one. A leaf counts the documents of each template; a document counts once for a line, however
   often it has it. A tree over ``MAX_TEMPLATES`` templates is sent off and begun anew.
2. *Merging.* The trees of all partitions are merged node by node: counts of equal templates at equal
   paths of a source are added.
3. *Check.* Templates that spell the same letters are the same line by the project's definition, however
   blanks cut them into tokens, so their counts are added; as a document counted for one of them only, the sum
   is the number of documents. A line that covers enough documents of its source is to be removed.

Lines are the parts of a text between line feeds, numbered from 1. Lines without letters never count.
Rows with a null source have no repeated lines; a null or empty text counts as a document without
lines. Rows repeated under one id each count as a document. Extra columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataclaim.session import broadcast_checked, write_cut

MIN_DOCS, MIN_SHARE = 5, 0.05
#: Levels of a tree that go by tokens.
DEPTH = 3
SLOT = b"<*>"
MAX_TEMPLATES = 200_000
#: Lines to remove up to which they are held by every task (16 bytes each beside their source).
MAX_HELD = 100_000

_NOT_LETTER = regex.compile(r"[^\p{L}]+")
_LOWER = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else 32 if chr(i).isspace() else 48 for i in range(256))
_NO_LETTER = bytes(i for i in range(256) if not (i < 128 and chr(i).isalpha()))


def letters(line: str) -> bytes:
    """The letters of a line, lower-cased, in UTF-8."""
    if line.isascii():
        return line.encode().translate(_LOWER, _NO_LETTER)
    return _NOT_LETTER.sub("", line).lower().encode("utf-8", "surrogatepass")


def tokens(line: str) -> list[bytes]:
    """The tokens of a line's template: letters of what stands between blanks, or a slot."""
    if line.isascii():
        found = [t.translate(None, b"0") for t in line.encode().translate(_LOWER).split()]
    else:
        found = [letters(t) for t in line.split()]
    out: list[bytes] = []
    for t in found:
        if t or not out or out[-1] is not SLOT:
            out.append(t or SLOT)
    return out


def digest(spelt: bytes) -> bytes:
    return xxhash.xxh3_128_digest(spelt)


class TokenTree:
    """Templates of the lines of each source, under their number of tokens and their first tokens."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.size = depth, 0
        self.root: dict = {}

    def add(self, source: str, spelt: bytes, line: str) -> None:
        """Count a document for a line."""
        ts = tokens(line)
        node = self.root.setdefault(source, {}).setdefault(len(ts), {})
        for k in range(self.depth):
            node = node.setdefault(ts[k] if k < len(ts) else b"", {})
        template = digest(b" ".join(ts))
        if (leaf := node.get(template)) is None:
            node[template] = [digest(spelt), ts.count(SLOT), 1]
            self.size += 1
        else:
            leaf[2] += 1

    def rows(self) -> Iterator[tuple]:
        """``(source, path, template, letters, slots, n_docs)`` of every template."""

        def walk(node: dict, path: tuple[bytes, ...], left: int) -> Iterator[tuple]:
            if left:
                for t, below in node.items():
                    yield from walk(below, (*path, t), left - 1)
            else:
                for template, (spelt, slots, n) in node.items():
                    yield b" ".join(path).decode("utf-8", "replace"), template, spelt, slots, n

        for source, sizes in self.root.items():
            for size, node in sizes.items():
                for row in walk(node, (str(size).encode(),), self.depth):
                    yield (source, *row)


_TREE = pa.schema([("source", pa.string()), ("path", pa.string()), ("template", pa.binary()), ("letters", pa.binary()), ("slots", pa.int32()), ("n", pa.int64())])


def _parse(depth: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TokenTree(depth)
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tree.rows()), _TREE.types)], names=_TREE.names)
        for b in batches:
            for source, text in zip(b.column(0), b.column(1)):
                seen, source = set(), source.as_py()
                for line in (text.as_py() or "").split("\n"):
                    if (spelt := letters(line)) and spelt not in seen:
                        seen.add(spelt)
                        tree.add(source, spelt, line)
                if tree.size >= most:
                    yield flush()
                    tree = TokenTree(depth)
        if tree.size:
            yield flush()

    return run


def repeated_templates(df: DataFrame, source_col: str, text_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, depth: int = DEPTH, max_templates: int = MAX_TEMPLATES) -> DataFrame:
    """Lines to remove: ``(source, letters, n_docs, n_source, templates, slots)``, letters being a hash of
    them, ``templates`` the number of templates that spell them and ``slots`` the most slots of one."""
    src = df.select(F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).where("source is not null")
    sizes, _ = broadcast_checked(src.groupBy("source").agg(F.count(F.lit(1)).alias("n_source")))
    trees = src.mapInArrow(_parse(depth, max_templates), "source string, path string, template binary, letters binary, slots int, n bigint")
    merged = trees.groupBy("source", "path", "template", "letters", "slots").agg(F.sum("n").alias("n"))
    spelt = merged.groupBy("source", "letters").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("templates"), F.max("slots").alias("slots"))
    return spelt.where(F.col("n_docs") >= min_docs).join(sizes, "source").where(F.col("n_docs") >= F.lit(min_share) * F.col("n_source"))


def _number_lines(keep):
    """``(id, source, line_no, letters)`` of the lines that ``keep(source, letters)`` is true of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, source, text in zip(*(b.column(k) for k in range(3))):
                wanted = keep(source.as_py())
                if wanted is not None and (t := text.as_py()):
                    for n, line in enumerate(t.split("\n"), 1):
                        if (spelt := letters(line)) and (not wanted or (key := digest(spelt)) in wanted):
                            rows.append((i.as_py(), source.as_py(), n, key if wanted else digest(spelt)))
            if rows:
                kinds = (b.schema.field(0).type, pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "source", "line_no", "letters"])

    return run


def held_lines(spark, hot: DataFrame, most: int):
    """The lines to remove by source, broadcast, if there are at most ``most`` of them; else None."""
    rows = hot.limit(most + 1).collect()
    if len(rows) > most:
        return None
    by_source: dict[str, set[bytes]] = defaultdict(set)
    for r in rows:
        by_source[r.source].add(bytes(r.letters))
    return spark.sparkContext.broadcast(dict(by_source))


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_held: int = MAX_HELD) -> DataFrame:
    """``(id_col, line_no)`` of each line to remove.

    Lines to remove are few (each covers ``min_share`` of a source, so a source has at most
    1 / min_share times its lines a document); if a count proves them to be at most ``max_held``, every
    task holds them and looks its lines up where they are. Beyond that lines are joined with them by
    salted keys.
    """
    hot = write_cut(repeated_templates(df, source_col, text_col, min_docs, min_share).select("source", "letters"))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).where("source is not null")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, source string, line_no bigint, letters binary"
    if (held := held_lines(df.sparkSession, hot, max_held)) is not None:
        found = rows.mapInArrow(_number_lines(lambda source: held.value.get(source)), schema)
    else:
        salts, every = 32, frozenset()
        found = rows.mapInArrow(_number_lines(lambda source: every), schema).withColumn("salt", F.pmod(F.xxhash64("id", "line_no"), F.lit(salts)))
        found = found.join(hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["source", "letters", "salt"], "left_semi")
    return found.select(F.col("id").alias(id_col), "line_no")


def _without(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for source, text in zip(b.column(1), b.column(2)):
                t, n = text.as_py(), 0
                if t and (wanted := held.value.get(source.as_py())):
                    lines = t.split("\n")
                    kept = [x for x in lines if not (spelt := letters(x)) or digest(spelt) not in wanted]
                    if n := len(lines) - len(kept):
                        t = "\n".join(kept)
                texts.append(t)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["id", "text", "n_removed"])

    return run


def remove_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_held: int = MAX_HELD) -> DataFrame:
    """``(id_col, text_col, n_removed)``: every row's text without its repeated lines.

    Rows without such lines keep their text as stored. No row is shuffled while the lines to remove are
    few; beyond ``max_held`` the rows are joined with their lines by id, which then must be unique.
    """
    hot = write_cut(repeated_templates(df, source_col, text_col, min_docs, min_share).select("source", "letters"))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    if (held := held_lines(df.sparkSession, hot, max_held)) is not None:
        out = rows.mapInArrow(_without(held), f"id {rows.schema['id'].dataType.simpleString()}, text string, n_removed int")
        return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_removed")
    found = repeated_lines(df, id_col, source_col, text_col, min_docs, min_share, max_held)
    drops = found.groupBy(id_col).agg(F.collect_set("line_no").alias("drops"))
    rows = df.select(id_col, F.col(text_col).alias("text")).join(drops, id_col, "left")
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("n"), x.alias("x")))
    kept = F.transform(F.filter(numbered, lambda s: ~F.array_contains(F.col("drops"), s["n"])), lambda s: s["x"])
    return rows.select(
        id_col, F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col), F.coalesce(F.size("drops"), F.lit(0)).alias("n_removed")
    )
