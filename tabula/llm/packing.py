"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into reciprocal classes: class j holds lengths in (capacity / (j + 1),
capacity / j], and a bin of class j takes exactly j pieces. Documents are cut so
that their pieces (but a short rest) have the largest length of a class,
``capacity // j``: full bins are then filled to a few tokens.

Tokens never move. Each worker tokenises and cuts its documents by itself; a
piece's place follows from its rank in its class. Ranks need only (class, bucket)
counts: a bucket ranks its own pieces, prefix sums of the counts give it its first
bin. The pieces left over in each class's last, partial bin (fewer than j a class, so at most
``leftover_bound(capacity)`` in all, whatever the input) are put together by
first fit, longest first.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabula.llm import textbytes as tb
from tabula.llm.scratch import small_batches, stored

CAPACITY = 2048
END_ID = 1
SHORTEST_CUT = 64
"""A rest up to this length isn't cut further."""

SLICE_BYTES = 1 << 20
"""Texts that are encoded at once: their words and ids take some 40 times that."""
CACHE_WORDS = 1 << 18
ENCODED_PARTS = 2000


def cut_lengths(tokens: int, capacity: int = CAPACITY, shortest: int = SHORTEST_CUT) -> list[int]:
    """The piece lengths of a document: whole capacities, then the largest ``capacity // j``
    that fits, again and again, until a rest of ``shortest`` or less is one piece."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest > shortest:
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return out + [rest] * (rest > 0)


def class_of(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def leftover_bound(capacity: int = CAPACITY, shortest: int = SHORTEST_CUT) -> int:
    """Most pieces that can be left in partial bins: below j for each class j in use."""
    lengths = {capacity // j for j in range(1, capacity // shortest + 1)} | set(range(1, shortest + 1))
    return sum(class_of(n, capacity) - 1 for n in lengths)


_PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!#$%&*+,./:;=?@^_|~-]*)$"


class WordEncoder:
    """Token ids of whole texts through the ids of their distinct words.

    The tokenizer never joins characters across white space, so a text's ids are
    the ids of its words in order. Words of plain letters with plain punctuation
    behind are encoded as these two parts; any other word is handed to the tokenizer as it
    is and is one part. Parts' ids lie in one array (``flat``, by ``first`` and ``size``), kept between
    texts; beyond CACHE_WORDS parts it starts anew.
    """

    def __init__(self, path: str):
        # Spark's tasks fill the cores: threads of the tokenizer would only add their own memory and spinning
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # the same model for lists of parts: each between spaces is one pre-token
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Lowercase()
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def _put(self, parts: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, parts])
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])

    def _rows(self, parts: pa.Array, plain: bool) -> np.ndarray:
        """The row of each of the (distinct) parts; new ones are encoded."""
        if not len(parts):
            return np.zeros(0, np.int32)
        # the known ones are looked up among the parts: a table of all known ones would be built anew each time
        at = pc.index_in(self.known, value_set=parts)
        rows = np.full(len(parts), -1, np.int32)
        rows[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        fresh = rows < 0
        unknown = parts.filter(pa.array(fresh))
        if not len(unknown):
            return rows
        rows[fresh] = len(self.known) + np.arange(len(unknown))
        new = unknown.to_pylist()
        # a few parts at a time: an encoding takes far more memory than its ids
        if plain:
            got = (self.parts.encode_batch_fast([" ".join(new[k : k + ENCODED_PARTS])], add_special_tokens=False)[0].ids for k in range(0, len(new), ENCODED_PARTS))
            ids = np.concatenate([np.array(g, np.uint32) for g in got])
            self._put(unknown, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        else:
            each = [[np.array(g.ids, np.uint32) for g in self.whole.encode_batch_fast(new[k : k + ENCODED_PARTS], add_special_tokens=False)] for k in range(0, len(new), ENCODED_PARTS)]
            got = [g for some in each for g in some]
            self._put(unknown, np.concatenate(got), np.array([len(g) for g in got]))
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the (non-null) texts in order, and how many each text has."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        split = pc.extract_regex(distinct, _PLAIN)
        # rows of each distinct word's one or two parts; row 0 is the empty part
        part = np.zeros((len(distinct), 2), np.int32)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        coded = [pc.struct_field(split, name).filter(pa.array(plain)).dictionary_encode() for name in ("core", "tail")]
        # no core is a tail: both are looked up at once
        rows = self._rows(pa.concat_arrays([c.dictionary for c in coded]), True)
        cores = len(coded[0].dictionary)
        for k, own in enumerate((rows[:cores], rows[cores:])):
            part[plain, k] = own[coded[k].indices.to_numpy()]
        part[~plain, 0] = self._rows(distinct.filter(pa.array(~plain)), False)
        # the distinct words' ids one behind the other, then those of every word
        of_word, n_word = self._spans(self.first[part.ravel()], self.size[part.ravel()])
        n_word = n_word[::2] + n_word[1::2]
        which = words.indices.to_numpy()
        at, n = self._spans((np.cumsum(n_word, dtype=np.int32) - n_word)[which], n_word[which])
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        bounds = lists.offsets.to_numpy()
        return self.flat[of_word][at], np.diff(total[bounds - bounds[0]])

    @staticmethod
    def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places first .. first + size - 1 of each span, one span behind the other; the sizes."""
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(first - (ends - size), size)
        at += np.arange(len(at), dtype=np.int32)
        return at, size


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
        tb.give_back()  # the vocabulary's text
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shortest: int = SHORTEST_CUT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of every piece of every row.

    ``tokenizer`` gives the vocabulary file's path on the machine that calls it. A null
    text is empty: its document is the end id alone.
    """
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType([src.schema[id_col], *longs, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def cut(encoder: WordEncoder, own_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, counts = encoder.encode(texts.cast(pa.large_string()).fill_null(""))
        stops = np.cumsum(counts)
        out: list[tuple] = []
        for k, (lo, hi) in enumerate(zip(stops - counts, stops, strict=True)):
            own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
            start = 0
            for length in cut_lengths(len(own), capacity, shortest):
                piece = own[start : start + length]
                out.append((k, start, length, zlib.crc32(piece.tobytes()), len(own), *([piece] if with_ids else [])))
                start += length
        cols = list(zip(*out, strict=True))
        arrays = [own_ids.take(pa.array(cols[0])), *(pa.array(c, pa.int64()) for c in cols[1:5])]
        if with_ids:
            arrays.append(tb.list_array(np.concatenate(cols[5]).astype(np.int64), np.array([len(p) for p in cols[5]]), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches):
        encoder = _encoder(tokenizer())
        for batch in batches:
            for at, end, _ in tb.slices(tb.texts_of(batch.column(1)), SLICE_BYTES):
                yield cut(encoder, batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at))
                tb.give_back()  # else new parts lie scattered over what the slice has freed

    return src.mapInArrow(tb.freeing(run), schema)


def _first_fit(capacity: int):
    def run(pdf):
        pdf = pdf.sort_values(["length", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        bins, offsets = [], []
        for n in pdf["length"]:
            k = next((i for i, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
            bins.append(k)
            offsets.append(capacity - room[k])
            room[k] -= n
        return pdf.assign(bin=bins, offset=offsets)[["key", "bin", "offset"]]

    return run


def pack(piece_rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``; ``order`` makes a row's place definite
    (rows equal in all of it are interchangeable). ``length`` lies in 1 .. capacity."""
    # one row for each piece, small; read again for counts and for places
    rows = stored(piece_rows.withColumn("class", F.floor(F.lit(capacity) / F.col("length"))), "pieces")
    # as many buckets as pieces in one: neither a bucket nor the table of counts grows with all pieces
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n"))
    totals = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).alias("full"))  # classes are at most `capacity`
    # at most `capacity` rows: the first sequence of each class
    firsts = totals.withColumn("base", F.sum("full").over(Window.orderBy("class")) - F.col("full"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*order)) - 1)
    ranked = ranked.join(F.broadcast(firsts), "class").join(before.drop("n"), ["class", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("at", F.floor(F.col("rank") / F.col("class"))).withColumn("left_over", F.col("at") >= F.col("full"))
    placed = ranked.where("not left_over")
    in_bin = Window.partitionBy("class", "at").orderBy("rank")
    placed = placed.withColumn("offset", F.sum("length").over(in_bin) - F.col("length")).withColumn("sequence_id", F.col("base") + F.col("at"))
    loose = ranked.where("left_over").withColumn("key", F.struct("class", "rank").cast("string"))
    loose = stored(loose, "loose")  # bounded by leftover_bound(capacity)
    fitted = loose.select("key", "length", F.lit(0).alias("all")).groupBy("all").applyInPandas(_first_fit(capacity), "key string, bin long, offset long")
    after = totals.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("base")).first()["base"]
    rest = loose.join(fitted, "key").withColumn("sequence_id", F.col("bin") + F.lit(after))
    cols = [c for c in piece_rows.columns if c not in ("sequence_id", "offset")]
    kinds = [F.col("sequence_id").cast("long"), F.col("offset").cast("long")]
    return placed.select(*cols, *kinds).unionByName(rest.select(*cols, *kinds))


def pack_documents(docs: DataFrame, tokenizer: Callable[[], str], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shortest: int = SHORTEST_CUT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence: (id, start, length,
    ids_crc32, doc_tokens[, ids], sequence_id, offset).

    Offsets in a sequence are gapless from 0. Empty and null texts are one end id. Repeated
    rows are packed each; rows with a null id too. An empty table gives no piece.
    """
    rows = pieces(docs, tokenizer, id_col, text_col, capacity, shortest, end_id, with_ids)
    with small_batches(docs.sparkSession):  # `pack` writes the pieces at once
        return pack(rows, [id_col, "start", "length", "ids_crc32", "doc_tokens"], capacity)
