"""Benchmark decontamination by an Aho-Corasick automaton.

Benchmark questions and answers are normalised to words; every window of
``width`` words (a shorter item: all of it) is a pattern. Patterns are made and
counted by Spark. As long as they fit into one block (``block_bytes`` of patterns
and item ids) one automaton holds them all, a worker process builds it once,
and each text is normalised and scanned once; nothing is shuffled. A larger
benchmark is cut into blocks of that size, so that neither the driver nor a
task ever holds more than one. Documents are then numbered and written once, and
scanned with each block; only the numbers and hits of those that were hit are
written for a block, and put together by number, so what is written does not grow
with the number of blocks.

Hits are mapped back to word numbers and, for spans, to character offsets of
the original text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared

#: Word bytes: digits, letters a-z and everything from 0x80; A-Z are lowered, all else parts words.
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
#: So many item ids of a pattern lie in one row; a window that more items share has several.
IDS_A_ROW = 1000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def windows_of(text: str | None, width: int = 13) -> list[str]:
    """The patterns of an item, each between single spaces."""
    words = words_of(text)
    last = max(1, len(words) - width + 1) if words else 0
    return [(b" " + b" ".join(words[i : i + width]) + b" ").decode("utf-8", "surrogatepass") for i in range(last)]


def build_patterns(benchmark: DataFrame, width: int, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """pattern, items (sorted distinct ids as strings; none for items without an id), bytes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in _shared.row_slices(batch, "text", 1_000_000):
                made = [windows_of(t, width) for t in rows.column("text").to_pylist()]
                at = pa.array([i for i, w in enumerate(made) for _ in w], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("item").take(at), pa.array([p for w in made for p in w], pa.string())], ["item", "pattern"])

    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text"))
    each = items.transform(_shared.in_arrow, run, "item string, pattern string").distinct()
    counts = each.groupBy("pattern").agg(F.ceil(F.count("*") / IDS_A_ROW).alias("rows"))
    dealt = each.join(counts, "pattern").withColumn("part", F.pmod(F.xxhash64("item"), F.col("rows")))
    merged = dealt.groupBy("pattern", "part").agg(F.array_sort(F.collect_list("item")).alias("items"))
    size = F.octet_length("pattern") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    return merged.select("pattern", "items", size.cast("long").alias("bytes"))


def _automaton(found: dict[str, list[str]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for pattern in found:
        machine.add_word(pattern, pattern)
    if found:
        machine.make_automaton()
    return machine


def _scan(rows: DataFrame, patterns: dict[str, list[str]], keep: list[str], with_spans: bool) -> DataFrame:
    """keep, n_words, hit (intervals of words, merged), item_ids, spans. rows: keep and __text."""
    sent, name = rows.sparkSession.sparkContext.broadcast(patterns), f"automaton {uuid.uuid4().hex}"  # one block
    schema = T.StructType([*(rows.schema[c] for c in keep), *T._parse_datatype_string("n_words long, hit array<struct<begin:int,end:int>>, item_ids array<string>, spans array<struct<item_id:string,begin:int,end:int>>").fields])

    def scan(batches):
        import re
        from bisect import bisect_right

        import pyarrow as pa

        found = sent.value
        machine = _shared.per_process(name, lambda: _automaton(found), family="automaton")
        word = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
        interval = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        result = pa.schema([("n_words", pa.int64()), ("hit", interval), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("item_id", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])))])

        def judged(original):
            words = words_of(original)
            row = {"n_words": len(words), "hit": [], "item_ids": [], "spans": []}
            if not words or not found:
                return row
            plain = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
            spaces, at, matched, places, merged = None, None, set(), set(), []
            for end, key in machine.iter(plain):
                if spaces is None:
                    spaces = [i for i, c in enumerate(plain) if c == " "]
                    at = [m.span() for m in word.finditer(original)] if with_spans else None
                stop = bisect_right(spaces, end) - 1
                start = stop - (key.count(" ") - 1)
                matched.add(key)
                while merged and merged[-1][1] >= start:  # hits come by their ends
                    start = min(start, merged.pop()[0])
                merged.append((start, stop))
                if with_spans:
                    first = stop - (key.count(" ") - 1)
                    places.update((x, at[first][0], at[stop - 1][1]) for x in found[key])
            row["hit"] = [{"begin": a, "end": b} for a, b in merged]
            row["item_ids"] = sorted({x for key in matched for x in found[key]})
            row["spans"] = [{"item_id": a, "begin": b, "end": c} for a, b, c in sorted(places)]
            return row

        for batch in batches:
            out = pa.RecordBatch.from_pylist([judged(t.as_py()) for t in batch.column("__text")], schema=result)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out.columns], [*keep, *result.names])

    return rows.transform(_shared.in_arrow, scan, schema)


def _blocks(patterns: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """patterns with a block number each, and how many blocks there are; a block has about block_bytes at most."""
    total = patterns.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    n = 1 if total <= block_bytes else -(-total * 5 // (4 * block_bytes))  # hashes deal them out almost evenly
    return patterns.withColumn("block", F.pmod(F.xxhash64("pattern", F.get("items", F.lit(0))), F.lit(n))), n


def _of_block(patterns: DataFrame, block: int) -> dict[str, list[str]]:
    """One block on the driver; it has a bound."""
    out: dict[str, list[str]] = {}
    for r in patterns.where(F.col("block") == block).select("pattern", "items").toLocalIterator():
        out[r["pattern"]] = sorted({*out.get(r["pattern"], []), *r["items"]})
    return out


def _n_hit():
    return F.aggregate("hit", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])


#: A word in a text as it is, for counting: A-Z are lowered before words are compared, and count as letters here.
_WORD_HERE = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"


def _together(parts: DataFrame) -> DataFrame:
    """The hits of several blocks by row number (``__row``): words hit in any of them count once."""
    merged = parts.groupBy("__row").agg(
        F.array_sort(F.flatten(F.collect_list("hit"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    added = lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["begin"], s["reach"]), F.lit(0))).alias("n"), F.greatest(s["reach"], x["end"]).alias("reach"))
    return merged.select("__row", F.aggregate("all", start, added)["n"].alias("n_hit"), "item_ids", "spans")


def _in_blocks(taken: DataFrame, patterns: DataFrame, n: int, own: list[str], with_spans: bool) -> DataFrame:
    """As _scan with all blocks one after the other. Only rows that some block may have hit are joined with their hits."""
    taken = _shared.materialize(taken.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    parts = []
    for block in range(n):
        hits = _scan(taken.select("__row", "__text"), _of_block(patterns, block), ["__row"], with_spans).where(F.size("hit") > 0)
        parts.append(_shared.materialize(hits.drop("n_words"), "block"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hits = _shared.materialize(_together(every), "hits")
    _shared.drop(*parts)
    counted = taken.select(*own, "__row", F.coalesce(F.regexp_count("__text", F.lit(_WORD_HERE)), F.lit(0)).cast("long").alias("n_words"))
    marked = _shared.marked(counted, "__row", hits, "__row")
    nothing = [F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"), F.array().cast(hits.schema["spans"].dataType).alias("spans")]
    names = [*own, "n_words"]
    clean = marked.where(~F.col("__maybe")).select(*names, *nothing)
    joined = marked.where("__maybe").join(hits, "__row", "left")
    return clean.unionByName(joined.select(*names, *[F.coalesce(c, e).alias(c) for c, e in zip(("n_hit", "item_ids", "spans"), nothing)]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20, keep: tuple[str, ...] = (), with_spans: bool = True) -> DataFrame:
    """Per document: id, n_words, n_hit, item_ids (sorted strings), spans of the original text (none unless asked for).

    A word inside any occurrence of a pattern is hit. Null and wordless texts
    have no words and no hits; items without words have no pattern; an item id
    of null hits words but names no item. Each row is judged by itself, repeated
    rows and ids too. ``keep`` names columns of docs that are handed on, whatever
    their names but those of the result. Texts of any length are scanned whole,
    and a benchmark of any size, in blocks of ``block_bytes`` of patterns. Empty
    tables give empty results, or documents without hits.
    """
    if taken := sorted(set(keep) & {id_column, "n_words", "n_hit", "item_ids", "spans"}):
        raise ValueError(f"these columns are part of the result, so they can't be kept: {taken}")
    patterns, n = _blocks(_shared.materialize(build_patterns(benchmark, width, item_column, item_text), "patterns"), block_bytes)
    at = {c: f"__{i}" for i, c in enumerate((id_column, *keep))}
    rows = docs.select(F.col(text_column).alias("__text"), *[F.col(f"`{c}`").alias(a) for c, a in at.items()])
    own = list(at.values())
    if n == 1:
        found = _scan(rows, _of_block(patterns, 0), own, with_spans).select(*own, "n_words", _n_hit().alias("n_hit"), "item_ids", "spans")
    else:
        found = _in_blocks(rows, patterns, n, own, with_spans)
    return found.select(*[F.col(a).alias(c) for c, a in at.items()], "n_words", "n_hit", "item_ids", "spans")


def contaminated(per_cent: int = 5):
    """The rule: some word is hit, and the hit words are at least this share of the document's words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * per_cent)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, per_cent: int = 5, text_column: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """docs without the contaminated rows, all columns as they were. Null and wordless texts stay; repeated rows share their fate; an empty table stays empty."""
    names = docs.columns
    at = {c: f"column {i}" for i, c in enumerate(names)}
    numbered = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in at.items()]).withColumn("__no", F.lit(0))
    found = find_contamination(numbered, benchmark, id_column="__no", text_column=at[text_column], keep=tuple(at.values()), block_bytes=block_bytes, with_spans=False)
    return found.where(~contaminated(per_cent)).select(*[F.col(at[c]).alias(c) for c in names])
