"""Source divergence audit: how far the word use of each source of a language lies from
its peers, and by which terms.

Each language keeps the terms of enough of its documents. A group (language, source) gives
every kept term a smoothed share in integer billionths; the distance of two groups is the
sum of the absolute differences of their shares over all kept terms.

The distances come from a row accumulation in Gustavson's manner. The cells (group, term,
share) of a language are dealt by term into blocks of bounded size. In a block, each group
runs through its own terms, reads each term's postings in the term-major index and adds
what the meeting changes to a dense accumulator with one place per peer; no pair of
postings is ever emitted. A term that a group doesn't have still has the group's base
share there, so the sums over terms that one side or none holds follow from sorted shares,
prefix sums and counts. Accumulators of blocks are added by key. All arithmetic is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabula.llm import textbytes as tb
from tabula.llm.scratch import stored

SCALE = 1_000_000_000
PRIOR = 5
MIN_DOCS = 30
TOP_TERMS = 50
BLOCK_CELLS, MOST_CELLS = 1 << 15, 1 << 21
"""Cells that a block holds on average: so many, or more with many peers, as a block gives up to
peers x peers sums; blocks are dealt by a hash of the term."""
KEPT_ROWS = 1 << 20
"""Kept terms up to so many rows are broadcast; more of them are joined by shuffle."""
BLOCK_PLACES = 1 << 21
"""Accumulator places (groups of a task x peers) that a task holds."""
SLICE_BYTES = 1 << 20
"""Texts that are cut into terms at once: their numbers take some 20 times that."""
MERGE_ROWS = 1 << 19
"""Counts of slices that a task holds before it adds them up (some 30 bytes a row, twice that meanwhile)."""
SENT_ROWS = 1 << 16

NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_TERM_ROWS = "lang string, source string, term string, n long, docs long"


def _added(lang: pa.Array, source: pa.Array, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    """One row for each (lang, source, term), with the sums of ``n`` and ``docs``; the columns of
    strings are dictionaries, and so are those of the result."""
    codes = [c.indices.to_numpy().astype(np.int64) for c in (lang, source, term)]
    pair, group = np.unique(codes[0] * max(len(source.dictionary), 1) + codes[1], return_inverse=True)
    size = max(len(term.dictionary), 1)
    key, at = np.unique(group * size + codes[2], return_inverse=True)
    del codes, group
    sums = [np.zeros(len(key), np.int64) for _ in range(2)]
    for total, part in zip(sums, (n, docs), strict=True):
        np.add.at(total, at, part)
    langs, sources = np.divmod(pair[key // size], max(len(source.dictionary), 1))
    strings = [pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), c.dictionary) for code, c in ((langs, lang), (sources, source), (key % size, term))]
    return pa.table([*strings, *map(pa.array, sums)], names=["lang", "source", "term", "n", "docs"])


def _term_counts(lang: pa.Array, source: pa.Array, texts: tb.Texts) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of a slice of rows."""
    words = tb.words_of(texts, NO_TERM)
    terms = tb.span_strings(tb.LOWER[texts.data], words.start, words.end).dictionary_encode()
    size = max(len(terms.dictionary), 1)
    doc_term, n = np.unique(words.row * size + terms.indices.to_numpy(), return_counts=True)
    # dictionaries hold what has rows only: texts without terms leave nothing behind
    row, at = np.unique(doc_term // size, return_inverse=True)
    own = [c.take(pa.array(row)).dictionary_encode().take(pa.array(at)) for c in (lang, source)]
    term = pa.DictionaryArray.from_arrays(pa.array((doc_term % size).astype(np.int32)), terms.dictionary.cast(pa.string()))
    return _added(*own, term, n, np.ones(len(n), np.int64))


def _merged(parts: list[pa.Table]) -> pa.Table:
    if len(parts) == 1:
        return parts[0]
    whole = pa.concat_tables(parts).unify_dictionaries().combine_chunks()
    return _added(*(whole[c].chunk(0) for c in ("lang", "source", "term")), *(whole[c].to_numpy() for c in ("n", "docs")))


def term_rows(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """(lang, source, term, n, docs), added up over slices of the rows; nulls count as ''."""
    src = docs.select(*(F.coalesce(c.cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))

    def sent(table: pa.Table):
        for at in range(0, table.num_rows, SENT_ROWS):
            piece = table.slice(at, SENT_ROWS)
            yield pa.RecordBatch.from_arrays([c.combine_chunks().cast(pa.string()) if pa.types.is_dictionary(c.type) else c.combine_chunks() for c in piece.columns], names=piece.column_names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for at, end, texts in tb.slices(tb.texts_of(batch.column(2)), SLICE_BYTES):
                part = _term_counts(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), texts)
                if not part.num_rows:
                    continue
                parts.append(part)
                held += part.num_rows
                if held < MERGE_ROWS:
                    continue
                parts = [_merged(parts)]
                held = parts[0].num_rows
                if 2 * held >= MERGE_ROWS:  # else there is room for more
                    yield from sent(parts[0])
                    parts, held = [], 0
        if parts:
            yield from sent(_merged(parts))

    return src.mapInArrow(tb.freeing(run), _TERM_ROWS)


def _share(n: str, total: str, kept: str) -> Column:
    """Smoothed share in billionths; integers of 38 digits hold any count."""
    return F.expr(f"1 + ({SCALE}BD * (cast({n} as decimal(20, 0)) + {PRIOR})) div (cast({total} as decimal(20, 0)) + {PRIOR}BD * {kept})")


def _by_group(values: np.ndarray, group: np.ndarray, bases: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """(wanted, bases): the sum of |value - base| over the values of each wanted group."""
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    first, ends = np.searchsorted(group, wanted), np.searchsorted(group, wanted, "right")
    out = np.zeros((len(wanted), len(bases)), np.int64)
    for k in range(len(wanted)):
        own = values[first[k] : ends[k]]
        sums = np.concatenate([[0], np.cumsum(own)])
        low = np.searchsorted(own, bases)
        out[k] = sums[-1] - 2 * sums[low] + bases * (2 * low - len(own))
    return out


def accumulate(group: np.ndarray, term: np.ndarray, share: np.ndarray, base: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(rows, groups): for each group of ``rows`` and every peer, the sum of absolute differences
    over the terms of a block that either of them has.

    ``group``, ``term``, ``share``: the block's cells; ``base``: each group's share of a term it lacks.
    """
    groups = len(base)
    out = _by_group(share, group, base, rows) + _by_group(share, group, base[rows], np.arange(groups)).T
    # the term-major index, and the cells of each group
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(int(term.max(initial=-1)) + 2))
    peers, shares = group[by_term], share[by_term]
    by_group = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[by_group], np.arange(groups + 1))
    for k, g in enumerate(rows):
        own = by_group[ends[g] : ends[g + 1]]
        first, size = starts[term[own]], starts[term[own] + 1] - starts[term[own]]
        if not len(own):
            continue
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        peer, theirs, mine = peers[at], shares[at], np.repeat(share[own], size)
        change = np.abs(mine - theirs) - np.abs(mine - base[peer]) - np.abs(theirs - base[g]) + np.abs(base[g] - base[peer])
        np.add.at(out[k], peer, change)
    return out


def _distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each group and every other group of its language."""
    places = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("lang_cells") / F.least(F.greatest(F.lit(BLOCK_CELLS), F.col("peers") * F.col("peers")), F.lit(MOST_CELLS)))))
    places = places.withColumn("step", F.greatest(F.lit(1), F.lit(BLOCK_PLACES).cast("long") / F.col("peers")).cast("long"))
    places = places.withColumn("parts", F.ceil(F.col("peers") / F.col("step")))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    left = cells.join(places.select("lang", "source", "place", "blocks", "parts"), ["lang", "source"]).select("lang", block, spread, "place", "term", "p")
    right = places.select("lang", "source", "place", "base", "held", "kept", "step", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = right.select("lang", "block", spread, "source", "place", "base", "held", "kept", "step")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, block, part = (k.as_py() for k in key)
        right = right.sort_by("place")
        names, base, held = right["source"].combine_chunks(), right["base"].to_numpy(), right["held"].to_numpy()
        step, kept = right["step"][0].as_py(), right["kept"][0].as_py()
        rows = np.arange(part * step, min((part + 1) * step, len(base)))
        term = left["term"].combine_chunks().dictionary_encode().indices.to_numpy() if left.num_rows else np.zeros(0, np.int64)
        out = accumulate(left["place"].to_numpy(), term, left["p"].to_numpy(), base, rows)
        if block == 0:  # terms that neither has, those of both counted twice above and below
            out += (kept - held[rows][:, None] - held[None, :]) * np.abs(base[rows][:, None] - base[None, :])
        mine, peer = np.divmod(np.arange(out.size), max(len(base), 1))
        other = rows[mine] != peer
        mine, peer = mine[other], peer[other]
        return pa.table({"lang": pa.array([lang] * len(mine), pa.string()), "source": names.take(pa.array(rows[mine])), "item": names.take(pa.array(peer)), "value": pa.array(out.reshape(-1)[other])})

    keys = ["lang", "block", "part"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    Part ``pair``: ``item`` is each other source of the language, ``value`` the distance.
    Part ``term``: ``item`` is a kept term that the source uses more than its language does
    (and at all), ``value`` by how much; ranks to ``top``. Ranks: greatest value first, ties
    by ``item``. Null texts, languages and sources count as ''. Repeated rows count as often
    as they occur. A language without kept terms has distances 0; a language with one source
    has no pairs. An empty table gives no rows; extra columns are ignored.
    """
    lang, source, text = (F.col(f"`{c}`") for c in (lang_col, source_col, text_col))
    rows = term_rows(docs, lang, source, text).groupBy("lang", "source", "term")
    counts = stored(rows.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")  # texts are read once
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"), "terms")
    wanted = F.broadcast(kept) if kept.limit(KEPT_ROWS + 1).count() <= KEPT_ROWS else kept
    cells = stored(counts.join(wanted, ["lang", "term"]).select("lang", "source", "term", "n"), "cells")

    named = docs.select(F.coalesce(lang.cast("string"), F.lit("")).alias("lang"), F.coalesce(source.cast("string"), F.lit("")).alias("source")).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    own = Window.partitionBy("lang")
    groups = named.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "held", "kept"])
    groups = groups.withColumn("place", F.row_number().over(own.orderBy("source")) - 1).withColumn("peers", F.count("*").over(own)).withColumn("lang_cells", F.sum("held").over(own))
    base = F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(F.lit(0)).cast("long")
    groups = stored(groups.withColumn("base", base).withColumn("place", F.col("place").cast("long")), "groups")

    shares = cells.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"]).withColumn("p", _share("n", "total", "kept").cast("long"))
    pairs = _distances(shares.select("lang", "source", "term", "p"), groups)

    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("kept").alias("lang_kept"))
    whole = cells.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(totals, "lang").withColumn("q", _share("lang_n", "lang_total", "lang_kept").cast("long"))
    more = shares.join(whole.select("lang", "term", "q"), ["lang", "term"]).where(F.col("p") > F.col("q"))
    terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    first = terms.select("*", rank).where(F.col("rank") <= top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", rank).unionByName(first)
