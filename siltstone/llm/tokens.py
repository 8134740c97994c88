"""Token ids in Parquet list columns, read selectively.

The writer's file format is Parquet with columns doc_id, part, file_start,
n_tokens and ids (a list of 32-bit integers): dictionary encoded where that is
smaller, else delta encoded (format version 2), with row groups and pages of a
stated size and page indexes. Metadata queries read a few bytes a document,
and a filter on doc_id (files are sorted by it) skips row groups and pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import _shared

END_ID = 1


#: Letters with ASCII signs after them; the tokenizer always parts the two. Apostrophes may belong to a contraction.
_CORE_TAIL = r"^(?P<core>\p{L}+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class _Memory:
    """Ids of the first ``limit`` distinct strings seen."""

    def __init__(self, limit: int) -> None:
        import numpy as np
        import pyarrow as pa

        self.limit, self.known = limit, pa.array([], pa.string())
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, units, encode):
        """units: distinct strings (Arrow). Their ids, laid end to end: flat, start, length."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        place = pc.fill_null(pc.index_in(units, self.known), -1).to_numpy()
        old, fresh = place >= 0, np.flatnonzero(place < 0)
        start, length = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        start[old], length[old] = self.start[place[old]], self.length[place[old]]
        flat = self.flat
        if len(fresh):
            new = units.take(pa.array(fresh))
            ids, n = encode(new.to_pylist())
            at = len(self.flat) + np.cumsum(n) - n
            start[fresh], length[fresh] = at, n
            flat = np.concatenate([self.flat, ids])
            kept = min(len(new), self.limit - len(self.known))
            if kept > 0:
                self.known = pa.concat_arrays([self.known, new.slice(0, kept)])
                self.flat = flat[: len(self.flat) + int(n[:kept].sum())]
                self.start, self.length = np.concatenate([self.start, at[:kept]]), np.concatenate([self.length, n[:kept]])
        return flat, start, length


class WordEncoder:
    """Encodes whole texts through their words, each distinct word once.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in order; likewise for a word of letters and
    the signs after it. Unknown words of letters are encoded many to a call: in
    this vocabulary the last token of each is marked. Where the marks do not
    come out right (letters that the tokenizer sees otherwise), and for all
    other words, each is encoded by itself. The first ``limit`` units are
    remembered.
    """

    CALL = 1000

    def __init__(self, path: str, limit: int = 240_000) -> None:
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # for lower-case ASCII letters, which nothing but white space parts
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.plain_words, self.other_words, self.rest = (_Memory(max(1, limit // n)) for n in (2, 4, 4))

    def _each(self, words: list[str]):
        import numpy as np

        ids = [e.ids for at in range(0, len(words), 10 * self.CALL) for e in self.tokenizer.encode_batch_fast(words[at : at + 10 * self.CALL], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths

    def _letters(self, words: list[str], tokenizer=None):
        """Ids and lengths of words of letters."""
        import numpy as np

        tokenizer = tokenizer or self.tokenizer

        flats, lengths = [], []
        for at in range(0, len(words), 50 * self.CALL):
            calls = [words[i : i + self.CALL] for i in range(at, min(at + 50 * self.CALL, len(words)), self.CALL)]
            for call, made in zip(calls, tokenizer.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False)):
                flat = np.array(made.ids, np.uint32)
                ends = np.flatnonzero(self.closes[np.minimum(flat, len(self.closes) - 1)]) + 1
                if len(ends) == len(call) and len(flat) == (ends[-1] if len(ends) else 0):
                    flats.append(flat), lengths.append(np.diff(ends, prepend=0))
                else:
                    flat, length = self._each(call)
                    flats.append(flat), lengths.append(length)
        return np.concatenate(flats), np.concatenate(lengths)

    def _words(self, words):
        """Ids of distinct words: flat, and start and length of each."""
        import numpy as np
        import pyarrow.compute as pc

        parts = pc.extract_regex(words, _CORE_TAIL)
        dotted = pc.match_substring(words, "\u0130")  # lower case ends in a mark, which joins the signs after it
        split = pc.and_(pc.is_valid(parts), pc.invert(dotted))
        plain = split.to_numpy(zero_copy_only=False)
        pieces = []
        cores = pc.struct_field(parts, "core").filter(split)
        ascii = pc.string_is_ascii(cores)
        lower = ascii.to_numpy(zero_copy_only=False)
        for units, rows, memory, encode in (
            (pc.ascii_lower(cores.filter(ascii)), np.flatnonzero(plain)[lower], self.plain_words, lambda x: self._letters(x, self.plain)),
            (cores.filter(pc.invert(ascii)), np.flatnonzero(plain)[~lower], self.other_words, self._letters),
            (pc.struct_field(parts, "tail").filter(split), np.flatnonzero(plain), self.rest, self._each),
            (words.filter(pc.invert(split)), np.flatnonzero(~plain), self.rest, self._each),
        ):
            coded = units.dictionary_encode()
            flat, start, length = memory.ids(coded.dictionary, encode)
            which = coded.indices.to_numpy() if len(coded) else np.empty(0, np.int64)
            pieces.append((flat, rows, start[which], length[which]))
        total = np.zeros(len(words), np.int64)
        for _, rows, _, length in pieces:
            total[rows] += length
        at = np.cumsum(total) - total
        out, filled = np.empty(int(total.sum()), np.uint32), at.copy()
        for flat, rows, start, length in pieces:
            shift = np.repeat(np.cumsum(length) - length, length)
            inner = np.arange(len(shift)) - shift
            out[np.repeat(filled[rows], length) + inner] = flat[np.repeat(start, length) + inner]
            filled[rows] += length
        return out, at, total

    def encode(self, texts):
        """texts: an Arrow string array. Returns all ids, each text closed by END_ID, and the offsets of the texts."""
        import numpy as np
        import pyarrow.compute as pc

        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        flat, start, length = self._words(coded.dictionary)
        word = coded.indices.to_numpy() if len(coded) else np.empty(0, np.int64)
        counts = length[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = ends[bounds - bounds[0]] + np.arange(len(bounds))
        take = np.repeat(start[word] - ends[:-1], counts) + np.arange(ends[-1])
        out = np.empty(offsets[-1], np.uint32)
        closing = np.zeros(offsets[-1], bool)
        closing[offsets[1:] - 1] = True
        out[closing] = END_ID
        out[~closing] = flat[take]
        return out, offsets


FILE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("file_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Encode whole texts and write them in ascending id order (null ids first, equal ids by text hash).

    Null texts count as empty: one end id. Other columns are not looked at. An
    empty table gives files without rows. ``part`` numbers the files in order
    and ``file_start`` counts the ids before a document in its file.
    """

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, seen, part = _shared.per_process(f"words {tokenizer}", lambda: WordEncoder(tokenizer)), 0, TaskContext.get().partitionId()
        for batch in batches:
            for rows in _shared.row_slices(batch, "text", 5_000_000):
                ids, offsets = encoder.encode(rows.column("text"))
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(offsets[:-1] + seen), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32))),
                ], ["doc_id", "part", "file_start", "n_tokens", "ids"])
                seen += int(offsets[-1])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), _shared.text_of(text_column).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10), "parquet.page.row.count.limit": "2000",
    }
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.transform(_shared.in_arrow, encode, FILE_SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The token files, with only the given columns read; filters on doc_id and n_tokens reach the files' indexes."""
    out = spark.read.schema(FILE_SCHEMA).parquet(path)
    return out.select(*columns) if columns else out


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from what was read back."""

    def check(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("ids")
            flat, bounds = ids.values.to_numpy().view("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("file_start"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "file_start", "n_tokens", "ids_crc32"])

    read = read_tokens(spark, path, "doc_id", "part", "file_start", "ids").transform(_shared.in_arrow, check, "doc_id long, part int, file_start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    totals = read_tokens(spark, path, "part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    bases = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return read.join(bases, "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
