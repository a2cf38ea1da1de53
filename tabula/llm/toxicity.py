"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: hits (insults, strong or mild, and verbs of harm), words of intent,
of address, of negation and of speech, and quotation marks. Five transducers read the
symbols of a clause, each the output of the one before:

* threat: harm under an intent is a threat, other harm nothing;
* insult: a mild hit behind another hit is an insult;
* negation: hits in its reach are marked as denied;
* reported speech: hits behind a verb of speech or between quotation marks are marked as told;
* target: keeps the clause's gravest hit and whether somebody is addressed near it.

They are composed into one table of states, so a clause is matched by one look-up per
symbol, for all clauses of a slice at once. A clause's label is what the composition says
at its end; its weight is the sum of its hits' weights. A document's score comes from its
clause weights by label.

Which words hit, and how much, is learned: whole words and prefixes (code points) that
significantly more toxic documents hold than others, with their log odds. The labels'
weights are a logistic regression, drawn to fixed values where labels say little. Both use
at most TRAIN_ROWS labelled rows, near copies once; hits are found for each half of them by
what the other half teaches, so that a word's weight isn't judged by the rows it was learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.llm import textbytes as tb
from tabula.llm.scratch import stored

TRAIN_ROWS = 20_000
MAX_UNITS = 20_000
"""Learned words and prefixes, the most significant ones."""
PREFIXES = range(4, 9)
PRODUCTIVE = 1.25
MIN_TOXIC = 3
"""Toxic documents that a unit needs at least."""
STRONG = 4.0
"""Log odds from which a hit is an insult by itself."""
MILD = 1.6
TOP_WEIGHT = 8.0
SCOPE = 8
"""Words that a negation, a speech verb, an intent or an address reaches."""
RIDGE = 1.0
SHINGLE, SKETCH = 4, 6
"""Words of a shingle and minima of a sketch, by which near copies among the labelled rows are found."""

# fixed values: seeds of the grammar in English, German, French and Spanish
SEED_WEIGHT = 4.0
INSULTS = "idiot moron imbecile bastard scumbag dummkopf arschloch vollidiot mistkerl imbécile connard crétin salaud idiota imbécil estúpido cabrón"
HARMS = "kill hurt destroy beat stab shoot töten umbringen verletzen schlagen tuer frapper blesser détruire matar golpear destruir lastimar"
INTENTS = "will shall gonna going must should werde werden sollte vais allons va veux voy vamos quiero debes"
ADDRESSES = "you your yours yourself u he she they them him her these those people everyone du dich dir dein deine euch ihr ihnen sie tu toi te ton ta vous votre ils elles usted ustedes tú ti tus ellos ellas"
NEGATIONS = "not no never none nobody neither nor cannot without nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ningún ninguna sin"
SPEECH = "said says say told claimed wrote called quoted reported alleged sagte sagt schrieb nannte behauptete dit disait écrit appelé dijo dice escribió llamó"

_OTHER, _MILD, _INSULT, _HARM, _INTENT, _ADDRESS, _NOT, _SPEECH, _QUOTE, _GAP = range(10)
_THREAT = 10  # made by the threat transducer
_HITS = (_MILD, _INSULT, _THREAT)
SYMBOLS = 10

Step = tuple[object, object]


def _threat(state: bool, symbol: int) -> Step:
    if symbol == _INTENT:
        return True, _OTHER
    if symbol == _HARM:
        return state, _THREAT if state else _OTHER
    return state and symbol != _GAP, symbol


def _insult(state: bool, symbol: int) -> Step:
    if symbol in (_MILD, _INSULT):
        return True, _INSULT if state else symbol
    return state and symbol != _GAP, symbol


def _negation(state: bool, symbol: int) -> Step:
    if symbol == _NOT:
        return True, _OTHER
    return (state and symbol != _GAP), ((symbol, state) if symbol in _HITS else symbol)


def _report(state: tuple[bool, bool], symbol) -> Step:
    said, quoted = state
    if symbol == _SPEECH:
        return (True, quoted), _OTHER
    if symbol == _QUOTE:
        return (said, not quoted), _OTHER
    if isinstance(symbol, tuple):
        return state, (*symbol, said or quoted)
    return (said and symbol != _GAP, quoted), symbol


def _gravity(hit) -> tuple:
    """Hits in ascending gravity: told and denied ones first, then mild, insult, threat."""
    return (-1,) if hit is None else (-(hit[1] + hit[2]), hit[0])


def _target(state: tuple, symbol) -> Step:
    """state: the gravest hit, whether it is addressed, whether an address and a hit are in reach."""
    hit, addressed, near, fresh = state
    if symbol == _ADDRESS:
        return (hit, addressed or fresh, True, fresh), _OTHER
    if symbol == _GAP:
        return (hit, addressed, False, False), _OTHER
    if isinstance(symbol, tuple):
        if hit is None or _gravity(symbol) > _gravity(hit):
            return (symbol, near, near, True), _OTHER
        return (hit, addressed or near, near, True), _OTHER
    return state, _OTHER


MACHINES = ((_threat, False), (_insult, False), (_negation, False), (_report, (False, False)), (_target, (None, False, False, False)))
LABELS = [(kind, denied, told, addressed) for kind, denied, told, addressed in product(_HITS, (False, True), (False, True), (False, True))]
"""What a clause can be: kind of its gravest hit, denied, told, addressed."""


def compose(machines=MACHINES) -> tuple[np.ndarray, np.ndarray]:
    """The transducers as one machine: the next state for (state, symbol), and each state's
    clause label at the end of a clause (-1: none). State 0 is the start."""
    first = tuple(s for _, s in machines)
    names, todo, table, labels = {first: 0}, [first], [], []
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(SYMBOLS):
            out, after = symbol, []
            for (move, _), s in zip(machines, state, strict=True):
                s, out = move(s, out)
                after.append(s)
            to = tuple(after)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        table.append(row)
        hit, addressed = state[-1][:2]
        labels.append(-1 if hit is None else LABELS.index((*hit, addressed)))
    return np.array(table), np.array(labels)


TABLE, END_LABEL = compose()


def _prior(label: tuple) -> float:
    """Weight of a clause label where nothing is learned: an address adds, denial and report take away."""
    kind, denied, told, addressed = label
    return max(0.2, {_MILD: 0.6, _INSULT: 1.2, _THREAT: 1.5}[kind] + 0.4 * addressed - 0.7 * denied - 0.5 * told)


PRIOR = np.array([-3.0, 0.0, 0.0, *(_prior(x) for x in LABELS)])
"""Weights of: the constant, the log of the words, the heaviest clause, and the clause labels."""

_LISTED = {w: s for s, words in ((_HARM, HARMS), (_INTENT, INTENTS), (_ADDRESS, ADDRESSES), (_NOT, NEGATIONS), (_SPEECH, SPEECH), (_INSULT, INSULTS)) for w in words.split()}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:\n")] = True
_WHOLE = np.uint64(0x5851F42D4C957F2D)
_WORDS = 0


@dataclass(frozen=True)
class Lexicon:
    """Learned hits: hashes of words and prefixes (ascending) with their weights."""

    units: np.ndarray
    weights: np.ndarray

    def of(self, units: np.ndarray) -> np.ndarray:
        if not len(self.units):
            return np.zeros(units.shape)
        at = np.minimum(np.searchsorted(self.units, units), len(self.units) - 1)
        return np.where(self.units[at] == units, self.weights[at], 0.0)


NOTHING = Lexicon(np.zeros(0, np.uint64), np.zeros(0))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def _spans(texts: tb.Texts) -> tuple[tb.Words, np.ndarray]:
    """The words (runs of letters) and the positions of quotation marks. Of the characters
    beyond ASCII all but Latin-1 marks, general and ideographic punctuation count as letters."""
    d = texts.data
    letter = _LETTER[d]
    after, later = (np.concatenate([d[k:], np.zeros(min(k, len(d)), np.uint8)]) for k in (1, 2))
    two = np.flatnonzero((d == 0xC2) & (after != 0xAA) & (after != 0xB5) & (after != 0xBA))
    three = np.flatnonzero((d == 0xE2) | ((d == 0xE3) & (after == 0x80)))
    for at, size in ((two, 2), (three, 3)):
        for k in range(size):
            letter[np.minimum(at + k, len(d) - 1)] = False
    quote = (d == 0x22) | ((d == 0xC2) & ((after == 0xAB) | (after == 0xBB))) | ((d == 0xE2) & (after == 0x80) & (later >= 0x9C) & (later <= 0x9F))
    return tb.spans_of(letter, texts.offsets), np.flatnonzero(quote)


def _units(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, 1 + prefixes): hashes of each distinct word and of its prefixes, which ones it has,
    and the next shorter prefix of each (0: none)."""
    texts = tb.texts_of(words)
    begin, end = texts.offsets[:-1], texts.offsets[1:]
    heads = np.flatnonzero((texts.data & 0xC0) != 0x80)
    first = np.searchsorted(heads, begin)
    size = np.searchsorted(heads, end) - first
    hashes, has = [tb.span_hashes(texts.data, begin, end) ^ _WHOLE], [np.ones(len(words), bool)]
    for k in PREFIXES:
        longer = size > k
        value = np.zeros(len(words), np.uint64)
        if longer.any():
            value[longer] = tb.span_hashes(texts.data, begin[longer], heads[first[longer] + k])
        hashes.append(value)
        has.append(longer)
    units, has = np.stack(hashes, 1), np.stack(has, 1)
    shorter = np.zeros_like(units)
    shorter[:, 2:] = units[:, 1:-1]
    last = has[:, 1:].sum(1)  # prefixes of a word; the longest one is next to the word
    shorter[:, 0] = np.where(last > 0, units[np.arange(len(units)), last], 0)
    return units, has, shorter


def _encoded(texts: tb.Texts) -> tuple[tb.Words, pa.Array, np.ndarray, np.ndarray]:
    words, quotes = _spans(texts)
    coded = tb.span_strings(texts.data, words.start, words.end).dictionary_encode()
    return words, coded.dictionary, coded.indices.to_numpy().astype(np.int64), quotes


def features(texts: tb.Texts, lexicon: Lexicon) -> np.ndarray:
    """(rows, len(PRIOR)) of lower-cased texts."""
    n = len(texts)
    words, distinct, code, quotes = _encoded(texts)
    out = np.zeros((n, len(PRIOR)))
    out[:, 0] = 1
    out[:, 1] = np.log1p(np.bincount(words.row, minlength=n))
    if not len(code):
        return out
    # symbol and weight of every distinct word
    listed = pa.array(list(_LISTED), distinct.type)
    place = pc.fill_null(pc.index_in(distinct, listed), -1).to_numpy()
    symbol = np.append(np.array(list(_LISTED.values())), _OTHER)[place]
    units, has, _ = _units(distinct)
    weight = np.where(has, lexicon.of(units), 0).max(1)
    weight = np.where(symbol == _INSULT, np.maximum(weight, SEED_WEIGHT), np.where(symbol == _HARM, np.maximum(weight, SEED_WEIGHT), weight))
    learned = (symbol != _HARM) & (weight > 0)
    symbol = np.where(learned, np.where(weight >= STRONG, _INSULT, _MILD), symbol)

    stops = np.concatenate([[0], np.cumsum(_STOP[texts.data])])
    clause_key = stops[words.start]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (words.row[1:] != words.row[:-1]) | (clause_key[1:] != clause_key[:-1])
    clause = np.cumsum(fresh) - 1
    marked = np.isin(symbol, (_MILD, _INSULT, _HARM))[code]
    hot = np.zeros(clause[-1] + 1, bool)
    hot[clause[marked]] = True
    if not hot.any():
        return out
    taken = np.flatnonzero(hot[clause] & (symbol[code] != _OTHER))
    # quotation marks of those clauses stand between their words
    before = np.searchsorted(words.start, quotes, "right") - 1
    ahead = np.minimum(before + 1, len(code) - 1)
    row, key = tb.row_of(texts.offsets, quotes), stops[quotes]
    fits = lambda w: (w >= 0) & (words.row[w] == row) & (clause_key[w] == key)
    home = np.where(fits(before), before, np.where(fits(ahead), ahead, -1))
    good = (home >= 0) & hot[clause[home]]
    at = np.concatenate([words.start[taken], quotes[good]])
    order = np.argsort(at, kind="stable")
    syms = np.concatenate([symbol[code[taken]], np.full(good.sum(), _QUOTE)])[order]
    gains = np.concatenate([np.where(marked[taken], weight[code[taken]], 0), np.zeros(good.sum())])[order]
    owner = np.concatenate([clause[taken], clause[home[good]]])[order]
    index = np.concatenate([taken, before[good]])[order]

    _, group, size = np.unique(owner, return_index=True, return_counts=True)
    far = np.zeros(len(syms), bool)
    far[1:] = (owner[1:] == owner[:-1]) & (index[1:] - index[:-1] > SCOPE)
    state = np.zeros(len(group), np.int64)
    by_size = np.argsort(-size, kind="stable")
    for k in range(int(size.max())):
        live = by_size[: np.searchsorted(-size[by_size], -k, "left")]  # the clauses with over k symbols
        here = group[live] + k
        now = np.where(far[here], TABLE[state[live], _GAP], state[live])
        state[live] = TABLE[now, syms[here]]
    label = END_LABEL[state]
    total = np.add.reduceat(gains, group)
    # harm without intent hits nothing, so such a clause may end without a label
    ended = label >= 0
    rows = words.row[np.searchsorted(clause, owner[group])][ended]
    np.add.at(out, (rows, 3 + label[ended]), total[ended])
    np.maximum.at(out, (rows, np.full(len(rows), 2)), total[ended])
    out[:, 2:] = np.log1p(out[:, 2:])
    return out


def _lowered(column: pa.Array) -> tb.Texts:
    return tb.texts_of(pc.utf8_lower(column.cast(pa.large_string())))


def _batches(batches, at: int) -> Iterator[tuple[pa.RecordBatch, int, int, tb.Texts]]:
    for batch in batches:
        for lo, hi, texts in tb.slices(_lowered(batch.column(at))):
            yield batch, lo, hi, texts


def _examples(taught: DataFrame) -> DataFrame:
    """The labelled documents without near copies: of documents of one label that share a
    minimum of shingle hashes, for any of SKETCH salts, the least by key stays. Otherwise
    every word of a text copied often would look like evidence. (Some documents that only
    share a passage go, too; the labelled rows are a sample anyway.)"""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in tb.slices(tb.texts_of(batch.column(2))):
                words = tb.words_of(texts)
                hashes = tb.span_hashes(texts.data, words.start, words.end)
                values, first = tb.window_hashes(hashes, words.row, SHINGLE)
                row = words.row[first]
                few = np.bincount(words.row, minlength=len(texts)) < SHINGLE  # their words stand for themselves
                alone = few[words.row]
                values, row = np.append(values, hashes[alone]), np.append(row, words.row[alone])
                order = np.argsort(row, kind="stable")
                values, row = values[order], row[order]
                rows, at = np.unique(row, return_index=True)
                sketch = [np.minimum.reduceat(tb.mix64(values + salt), at).view(np.int64) for salt in np.arange(SKETCH, dtype=np.uint64) * _WHOLE] if len(rows) else []
                for k, least in enumerate(sketch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), batch.column(1).slice(lo, hi - lo).take(pa.array(rows)), pa.array(np.full(len(rows), k, np.int32)), pa.array(least)], names=["__key", "__y", "k", "least"])

    marks = taught.select("__key", "__y", "__text").mapInArrow(run, "__key long, __y int, k int, least long")
    first = F.min("__key").over(Window.partitionBy("__y", "k", "least"))
    copies = marks.withColumn("first", first).where("__key > first").select("__key").distinct()
    return taught.dropDuplicates(["__key"]).join(copies, "__key", "left_anti")


def _unit_counts(rows: DataFrame) -> DataFrame:
    """(unit, parent, a0, a1, b0, b1): toxic and other documents of each half that hold a word or prefix
    (``parent``: the next shorter prefix); unit _WORDS: the documents' distinct words, added up."""
    src = rows.select("__text", "__y", "__half")

    def run(batches):
        for batch, lo, hi, texts in _batches(batches, 0):
            words, distinct, code, _ = _encoded(texts)
            if not len(code):
                continue
            units, has, shorter = _units(distinct)
            known, first, at = np.unique(units[has], return_index=True, return_inverse=True)
            parent = np.append(np.uint64(0), shorter[has][first])
            place = np.full(units.shape, -1)
            place[has] = at
            kind = (2 * (1 - batch.column(1).slice(lo, hi - lo).to_numpy()) + batch.column(2).slice(lo, hi - lo).to_numpy()).astype(np.int64)
            pair = np.unique(words.row * len(distinct) + code)
            total = np.bincount(kind[pair // len(distinct)], minlength=4)
            doc, unit = np.repeat(pair // len(distinct), units.shape[1]), place[pair % len(distinct)].reshape(-1)
            pair = np.unique((doc * len(known) + unit)[unit >= 0])
            doc, unit = pair // len(known), pair % len(known)
            counts = np.bincount(unit * 4 + kind[doc], minlength=4 * len(known)).reshape(-1, 4)
            counts, known = np.vstack([total, counts]), np.append(np.uint64(_WORDS), known)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(parent.view(np.int64)), *(pa.array(counts[:, k]) for k in range(4))], names=["unit", "parent", "a0", "a1", "b0", "b1"])

    parts = src.mapInArrow(run, "unit long, parent long, a0 long, a1 long, b0 long, b1 long")
    return parts.groupBy("unit").agg(F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")))


def _evidence(a, b, toxic, other, part):
    """Twice the log likelihood ratio of a unit's documents against one rate for both
    classes; ``part(n, want)`` is n log(n / want), of arrays or columns."""
    rate = (a + b) / (toxic + other)
    return 2 * (part(a, toxic * rate) + part(b, other * rate))


def _lexicon(units: np.ndarray, parents: np.ndarray, a: np.ndarray, b: np.ndarray, toxic: int, other: int, kinds: int) -> Lexicon:
    """The units whose evidence is beyond chance among ``kinds`` of them. ``toxic`` and ``other``
    are distinct words of the classes' documents, so longer documents don't speak against their words.
    A prefix must say more than any one word or longer prefix that starts with it (PRODUCTIVE)."""
    if not toxic or not other or not len(units):
        return NOTHING
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = _evidence(a, b, toxic, other, lambda n, want: np.where(n > 0, n * np.log(n / want), 0.0))
    odds = np.log((a + 0.5) / toxic) - np.log((b + 0.5) / other)
    by_unit = np.argsort(units)
    at = np.minimum(np.searchsorted(units[by_unit], parents), len(units) - 1)
    known = units[by_unit][at] == parents
    longest = np.zeros(len(units))
    np.maximum.at(longest, by_unit[at[known]], a[known])
    good = (a >= MIN_TOXIC) & (odds >= MILD) & (evidence > 2 * np.log(max(kinds, 2))) & (a >= PRODUCTIVE * longest)
    order = np.argsort(units[good])
    return Lexicon(units[good][order], np.minimum(odds[good][order], TOP_WEIGHT))


def _regression(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Logistic regression with weights drawn to ``prior``; the constant is drawn less."""
    pull = np.full(len(prior), ridge)
    pull[0] = ridge / 100
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(y, x): the features of the rows' texts."""

    def run(batches):
        for batch, lo, hi, texts in _batches(batches, 0):
            x = features(texts, lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), tb.list_array(x.reshape(-1), np.full(len(x), x.shape[1]), pa.float64())], names=["y", "x"])

    return docs.select("__text", "__y").mapInArrow(run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled documents, or from the ``rows`` of them that come first by a hash of the id.

    Null ids, texts and labels teach nothing; of an id with several labels the more frequent
    counts, a draw teaches nothing. Without both classes only the seeds and fixed weights remain.
    """
    label = F.col(f"`{label_col}`").cast("double")
    known = labels.where(label.isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.avg((label > 0).cast("double")).alias("__share")).where("__share <> 0.5")
    place = F.pmod(F.xxhash64("__id"), F.lit(1 << 40))
    share = min(1.0, 2 * rows / max(known.count(), 1))
    known = known.where(place < int(share * (1 << 40))).orderBy(place, "__id").limit(rows)
    known = known.select("__id", (F.col("__share") > 0.5).cast("int").alias("__y"), F.pmod(F.xxhash64("__id") / 2, F.lit(2)).cast("int").alias("__half"))
    texts = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    taught = texts.join(known, "__id").withColumn("__key", F.xxhash64("__id", "__text"))
    taught = stored(_examples(stored(taught, "labelled")), "taught")
    if taught.select("__y").distinct().count() < 2:
        return Model(NOTHING, PRIOR)
    counts = stored(_unit_counts(taught), "units")
    kinds = counts.count()
    total = counts.where(F.col("unit") == _WORDS).first()
    if total is None:
        return Model(NOTHING, PRIOR)
    counts = counts.where(F.col("unit") != _WORDS)
    toxic, other = np.array([total.a0, total.a1], float), np.array([total.b0, total.b1], float)
    a, b = F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1")
    t, o = max(float(toxic.sum()), 1.0), max(float(other.sum()), 1.0)
    evidence: Column = _evidence(a, b, F.lit(t), F.lit(o), lambda n, want: F.when(n > 0, n * F.log(n / want)).otherwise(0.0))
    got = counts.where((a >= MIN_TOXIC) & (a / t > b / o)).orderBy(F.desc(evidence), "unit").limit(MAX_UNITS).toPandas()
    units, parents = (got[c].to_numpy(np.int64).view(np.uint64) for c in ("unit", "parent"))
    halves = [(got[f"a{h}"].to_numpy(np.float64), got[f"b{h}"].to_numpy(np.float64)) for h in (0, 1)]
    x, y = [], []
    for h in (0, 1):  # each half is read with what the other one teaches
        lexicon = _lexicon(units, parents, *halves[1 - h], toxic[1 - h], other[1 - h], kinds)
        part = _scored(taught.where(F.col("__half") == h), lexicon).toPandas()
        if len(part):
            x.append(np.stack(part["x"].to_list()))
            y.append(part["y"].to_numpy(np.float64))
    weights = _regression(np.concatenate(x), np.concatenate(y), PRIOR)
    return Model(_lexicon(units, parents, halves[0][0] + halves[1][0], halves[0][1] + halves[1][1], toxic.sum(), other.sum(), kinds), weights)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, with ``score`` (0 to 1), the
    probability that the text is toxic.

    Whole texts are read. A null or empty text has no clause and gets the constant's score.
    Repeated rows are scored alike; a column ``score`` of ``docs`` is replaced; an empty table
    gives no rows.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    src = docs.select(*(F.col(f"`{c}`") for c in cols), F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch, lo, hi, texts in _batches(batches, len(cols)):
            p = model.probability(features(texts, model.lexicon))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(cols))), pa.array(p)], names=schema.names)

    return src.mapInArrow(run, schema)
