"""A hidden Markov language model of whole texts.

Tokens are words (A-Z as a-z) and one end a text. The most frequent words emit for themselves; every other word belongs to
a class by its shape. A state emits the class, and the class's mass in the state is shared among its words by their
state-wise counts, smoothed by the class's: (count + 0.1) times the share of the word's occurrences that lie in the state. One
more word of each class stands for all unseen ones. So every word has its own emissions, the model gives every text a
probability, and all texts together have at most 1.

Counts of all words are combined map-side and summed by a shuffle. Every pass of Baum-Welch runs on all training texts: each task
sums its expected counts, a shuffle adds them up, and only the sums of classes (states times classes, a fixed number) reach
the driver. The last pass also sums the states of every word, as rows (token, states) that stay distributed; they grow with
the corpus. Scores are exact scaled forward recursions. Words outside the bounded table
that every task gets find their counts and states by a join, so neither memory nor a broadcast grows with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.batches import rows
from tenurekit.llm.scratch import staged
from tenurekit.llm.words import SHAPES, word_shapes

STATES = 8
#: Words that emit for themselves, and words whose counts every task gets.
OWN, TABLE = 8_192, 1 << 19
CLASSES = 1 + OWN + SHAPES
#: Passes over all training texts.
PASSES = 13
#: Tokens of a training sequence: longer texts are trained on in pieces (scored whole).
PIECE = 1_000
#: Words a task counts before it reports them; tokens and sequences in one NumPy batch.
COUNTED, BATCH_TOKENS, BATCH_TEXTS = 2_000_000, 1_000_000, 4_096
ALPHA = 0.1
#: State-wise counts are smoothed by so many occurrences spread as the class; a word seen under KEEP times (in no training text)
#: is spread as its class.
PRIOR, KEEP = 4.0, 1
#: Forward and backward sums are scaled once in so many tokens of training.
SCALED = 8
#: Rows of word sums in one batch.
REPORTED = 65_536
END = np.uint64(0x454E44)
_VOCABULARY = "token bigint, shape int, found bigint"


def _texts(batches: Iterator[pa.RecordBatch], at_once: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            yield part, part.column("text").cast(pa.large_binary()).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, texts_seen = [], 0

    def report() -> pa.RecordBatch:
        tokens, first, found = np.unique(np.concatenate([h for h, _ in held]), return_index=True, return_counts=True)
        shape = np.concatenate([s for _, s in held])[first]
        held.clear()
        return rows(_VOCABULARY, token=tokens.view(np.int64), shape=shape, found=found)

    for _, texts in _texts(batches):
        hashes, _, shapes = word_shapes(texts)
        texts_seen += len(texts)
        if len(hashes):
            held.append((hashes, shapes))
        if sum(len(h) for h, _ in held) > COUNTED:
            yield report()
    if held:
        yield report()
    if texts_seen:
        yield rows(_VOCABULARY, token=[int(END)], shape=[-1], found=[texts_seen])


@dataclass
class Vocabulary:
    """What every task gets: at most TABLE words with counts, the first OWN of them emitting for themselves."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    shapes: np.ndarray
    own: np.ndarray  # class of a word that emits for itself, else 0
    ends: int
    totals: np.ndarray  # of the classes by shape: sum of count + ALPHA, and ALPHA for unseen words
    n_tokens: int
    n_words: int

    @property
    def known(self) -> int:
        """Ids of what every task knows: 0 is the end, 1 + i word i. Greater ids are words that the table lacks."""
        return len(self.words) + 1

    @property
    def classes(self) -> np.ndarray:
        return np.concatenate(([0], np.where(self.own > 0, self.own, 1 + OWN + self.shapes))).astype(np.uint16)

    def unigram(self) -> np.ndarray:
        p = np.full(CLASSES, ALPHA)
        p[0] = self.ends + ALPHA
        p[self.own[self.own > 0]] += self.counts[self.own > 0]
        p[1 + OWN :] = self.totals
        return p / p.sum()


_CODED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, ids binary, tail array<bigint>, tail_shapes binary, times array<bigint>"


def _code(shared: object) -> Callable:
    """Texts as ids, with what the table knows of their words; words outside it are listed with shape and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        row = TaskContext.get().partitionId() << 40
        log_counts = np.log10(v.counts + ALPHA)
        for part, texts in _texts(batches):
            hashes, offsets, shapes = word_shapes(texts)
            at = np.minimum(np.searchsorted(v.words, hashes), max(0, len(v.words) - 1))
            known = v.words[at] == hashes if len(v.words) else np.zeros(len(hashes), bool)
            of_word = np.where(known, log_counts[at], 0.0) if len(v.words) else np.zeros(len(hashes))
            n_known, logs = (x[offsets[1:]] - x[offsets[:-1]] for x in (np.concatenate(([0], np.cumsum(x))) for x in (known, of_word)))
            tails, kinds, times, coded = [], [], [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                missing = ~known[lo:hi]
                tail, first, back, n = np.unique(hashes[lo:hi][missing], return_index=True, return_inverse=True, return_counts=True)
                ids = (at[lo:hi] + 1).astype(np.int32)
                ids[missing] = v.known + back
                tails.append(tail.view(np.int64))
                kinds.append(shapes[lo:hi][missing][first].astype(np.uint8).tobytes())
                times.append(n)
                coded.append(ids.tobytes() + bytes(4))
            yield rows(
                _CODED, row=np.arange(row, row + len(texts)), doc_id=part.column("doc_id"), held_out=part.column("held_out"), n_tokens=np.diff(offsets) + 1,
                n_known=n_known + (v.ends > 0), log_counts=logs + np.log10(v.ends + ALPHA), ids=coded, tail=tails, tail_shapes=kinds, times=times,
            )
            row += len(texts)

    return run


class _Held:
    """Sequences of some texts in one numbering: the ids that all know, then the words that the table lacks, text after text."""

    def __init__(self, known: int) -> None:
        self.known, self.n_tail = known, 0
        self.sequences: list[np.ndarray] = []
        self.first: list[bool] = []
        self.shapes: list[np.ndarray] = [np.empty(0, np.uint8)]
        self.tails: list[np.ndarray] = [np.empty(0, np.int64)]

    def take(self, ids: np.ndarray, shapes: bytes, tail: np.ndarray | None = None) -> np.ndarray:
        """The ids in the common numbering."""
        if shapes:
            ids = np.where(ids >= self.known, ids + self.n_tail, ids).astype(np.int32)
            self.shapes.append(np.frombuffer(shapes, np.uint8))
            if tail is not None:
                self.tails.append(tail)
            self.n_tail += len(shapes)
        return ids

    def classes(self, known: np.ndarray) -> np.ndarray:
        return np.concatenate((known, 1 + OWN + np.concatenate(self.shapes).astype(np.uint16)))


@dataclass
class Model:
    start: np.ndarray  # states of a text's first token
    inside: np.ndarray  # states of a later piece's first token
    moves: np.ndarray  # states x states
    emits: np.ndarray  # classes x states

    @staticmethod
    def random(unigram: np.ndarray) -> Model:
        r = np.random.default_rng(5)
        emits = unigram[:, None] * r.uniform(0.5, 1.5, (len(unigram), STATES))
        moves = r.uniform(0.5, 1.5, (STATES, STATES)) + 4 * np.eye(STATES)
        even = np.full(STATES, 1 / STATES)
        return Model(even, even, moves / moves.sum(1, keepdims=True), emits / emits.sum(0))

    def refitted(self, sums: np.ndarray, unigram: np.ndarray) -> Model:
        """From expected counts: rows by class, then by state moved from, then first tokens of texts and of pieces."""
        emits = sums[:CLASSES] + 2.0 * unigram[:, None]
        moves = sums[CLASSES : CLASSES + STATES] + 0.1
        start, inside = sums[CLASSES + STATES] + 0.1, sums[:CLASSES].sum(0) + 0.1
        return Model(start / start.sum(), inside / inside.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def _grid(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, grid, active): sequences by length, longest first, as columns of a grid; active[t]: columns that reach token t."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    grid = np.zeros((len(order), lengths[0]), sequences[0].dtype)
    for row, i in enumerate(order):
        grid[row, : lengths[row]] = sequences[i]
    return order, np.ascontiguousarray(grid.T), np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


_ONES = np.ones(STATES)


def log_likelihoods(model: Model, sequences: list[np.ndarray], emits: np.ndarray | None = None) -> np.ndarray:
    """log10 of each sequence's probability, by the forward recursion scaled to sum 1 at each token. emits: of ids, if not of classes."""
    order, grid, active = _grid(sequences)
    emits = model.emits if emits is None else emits
    total = np.zeros(len(order))
    alpha = model.start * emits[grid[0]]
    for t in range(len(grid)):
        n = active[t]
        if t:
            alpha = alpha[:n] @ model.moves
            alpha *= emits.take(grid[t, :n], 0)
        scale = alpha @ _ONES
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], first: np.ndarray, words: list[np.ndarray] | None = None, n_words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of one Baum-Welch pass, and states of words. first: which sequences begin a text; words: the sequences as numbers below n_words."""
    order, grid, active = _grid(sequences)
    first = first[order]
    # one row a token: those of all first tokens, of all second ones, and so on
    at = np.concatenate(([0], np.cumsum(active)))
    alphas, scales, ends = np.empty((at[-1], STATES)), {}, np.empty(len(order))
    alpha = np.where(first[:, None], model.start, model.inside) * model.emits[grid[0]]
    for t in range(len(grid)):
        n = active[t]
        if t:
            alpha = alpha[:n] @ model.moves
            alpha *= model.emits.take(grid[t, :n], 0)
        if t % SCALED == 0:
            scales[t] = alpha @ _ONES
            alpha /= scales[t][:, None]
        alphas[at[t] : at[t + 1]] = alpha
        going_on = active[t + 1] if t + 1 < len(grid) else 0
        ends[going_on:n] = alpha[going_on:] @ _ONES
    beta, moves, back = np.repeat(1 / ends[:, None], STATES, axis=1), np.zeros((STATES, STATES)), np.ascontiguousarray(model.moves.T)
    for t in range(len(grid) - 1, 0, -1):
        n = active[t]
        ahead = model.emits.take(grid[t, :n], 0)
        ahead *= beta[:n]
        if t in scales:
            ahead /= scales[t][:, None]
        moves += alphas[at[t - 1] : at[t - 1] + n].T @ ahead
        alphas[at[t] : at[t + 1]] *= beta[:n]
        beta[:n] = ahead @ back
    alphas[: at[1]] *= beta
    live = np.arange(len(order)) < active[:, None]
    numbers = None if words is None else _grid(words)[1][live]
    tokens = grid[live]
    sums = np.zeros((CLASSES + STATES + 1, STATES))
    of_words = np.zeros((n_words, STATES))
    for k in range(STATES):
        weights = np.ascontiguousarray(alphas[:, k])
        sums[:CLASSES, k] = np.bincount(tokens, weights=weights, minlength=CLASSES)
        if numbers is not None:
            of_words[:, k] = np.bincount(numbers, weights=weights, minlength=n_words)
    sums[CLASSES : CLASSES + STATES] = moves * model.moves
    sums[-1] = alphas[: at[1]][first].sum(0)
    return sums, of_words


def _pieces(known: int, batches: Iterator[pa.RecordBatch]) -> Iterator[_Held]:
    """Training sequences, a NumPy batch at a time. Columns: ids, tail_shapes and, where words are counted, tail."""
    held, at_once = _Held(known), BATCH_TEXTS // 4
    for batch in batches:
        tails = batch.column(2) if batch.num_columns > 2 else None
        for i, (text, shapes) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            whole = np.frombuffer(text, np.int32)
            tail = tails[i].values.to_numpy() if tails is not None else None
            for at in range(0, len(whole), at_once * PIECE):
                ids = held.take(whole[at : at + at_once * PIECE], shapes, tail)
                for begin in range(0, len(ids), PIECE):
                    held.sequences.append(ids[begin : begin + PIECE])
                    held.first.append(at + begin == 0)
                if len(held.sequences) >= at_once:
                    yield held
                    held = _Held(known)
    if held.sequences:
        yield held


_STATES = [f"s{k}" for k in range(STATES)]
_SUMS = "place int, token bigint, shape int, found bigint, " + ", ".join(f"{s} double" for s in _STATES)


def _columns(sums: np.ndarray) -> dict[str, np.ndarray]:
    return {s: sums[:, k] for k, s in enumerate(_STATES)}


def _word_sums(tokens: np.ndarray, shapes: np.ndarray, found: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums in steps of 1/256, which compress."""
    for at in range(0, len(tokens), REPORTED):
        part = slice(at, at + REPORTED)
        yield rows(_SUMS, token=tokens[part].view(np.int64), shape=shapes[part], found=found[part], **_columns(np.rint(sums[part] * 256) / 256))


def _expect(model: object, vocabulary: object, *, by_word: bool = False) -> Callable:
    """Expected counts of a task's texts by class; by_word: of each word, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        classes, sums = v.classes, np.zeros((CLASSES + STATES + 1, STATES))
        of_table, in_texts = np.zeros((v.known if by_word else 0, STATES)), np.zeros(v.known, np.int64)
        for held in _pieces(v.known, batches):
            of_id = held.classes(classes)
            first, sequences = np.array(held.first), [of_id[s] for s in held.sequences]
            if not by_word:
                sums += expected_counts(model.value, sequences, first)[0]
                continue
            found, of_words = expected_counts(model.value, sequences, first, held.sequences, len(of_id))
            times = np.bincount(np.concatenate(held.sequences), minlength=len(of_id))
            sums += found
            of_table += of_words[: v.known]
            in_texts += times[: v.known]
            tail = np.concatenate(held.tails)
            tokens, at, back = np.unique(tail, return_index=True, return_inverse=True)
            totals, counts = np.zeros((len(tokens), STATES)), np.zeros(len(tokens), np.int64)
            np.add.at(totals, back, of_words[v.known :])
            np.add.at(counts, back, times[v.known :])
            seen = np.flatnonzero(counts)  # a long text comes in parts, each with the words of all
            yield from _word_sums(tokens[seen], np.concatenate(held.shapes)[at][seen].astype(np.int32), counts[seen], totals[seen])
        some = np.flatnonzero(sums.any(1))
        if len(some):
            yield rows(_SUMS, place=some, **_columns(sums[some]))
        if by_word:
            some = np.flatnonzero((v.own == 0) & (v.counts >= KEEP) & (in_texts[1:] > 0))
            yield from _word_sums(v.words[some], v.shapes[some], in_texts[1:][some], of_table[1:][some])

    return run


def _gathered(sums: DataFrame) -> np.ndarray:
    """At most one row for each class, state and start."""
    table = sums.where("place is not null").select("place", *_STATES).toArrow()
    out = np.zeros((CLASSES + STATES + 1, STATES))
    out[table.column("place").to_numpy()] = np.stack([table.column(s).to_numpy() for s in _STATES], axis=1)
    return out


@dataclass
class Shares:
    """How a class's mass in a state is shared among its words."""

    spread: np.ndarray  # shapes x states: where the class's words occur, rows of sum 1
    mass: np.ndarray  # shapes x states: sum of the weights of the class's words, all unseen ones as one

    def spreads(self, shapes: np.ndarray, found: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """States' shares of words, from their numbers and state-wise counts (both 0 where not kept)."""
        return (sums + PRIOR * self.spread[shapes]) / (found + PRIOR)[:, None]

    def emits(self, model: Model, shapes: np.ndarray, found: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Emissions of words, but for the factor count + ALPHA."""
        return model.emits[1 + OWN + shapes] * self.spreads(shapes, found, sums) / self.mass[shapes]


def _weights(spread: np.ndarray) -> Callable:
    """By shape: sum of count + ALPHA of the words with states (found), and of their weights in each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, total, mass = Shares(spread, spread), np.zeros(SHAPES), np.zeros((SHAPES, STATES))
        for batch in batches:
            shapes, found = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sums = np.stack([batch.column(2 + k).to_numpy() for k in range(STATES)], axis=1)
            np.add.at(total, shapes, found + ALPHA)
            np.add.at(mass, shapes, (found + ALPHA)[:, None] * shares.spreads(shapes, found, sums))
        some = np.flatnonzero(total)
        if len(some):
            yield rows(_WEIGHTS, shape=some, found=total[some], **_columns(mass[some]))

    return run


_WEIGHTS = "shape int, found double, " + ", ".join(f"{s} double" for s in _STATES)


def _of_table(vocabulary: object) -> Callable:
    """The rows of words that the table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value.words
        for batch in batches:
            tokens = batch.column(0).to_numpy().view(np.uint64)
            if len(words):
                at = np.minimum(np.searchsorted(words, tokens), len(words) - 1)
                yield batch.filter(pa.array(words[at] == tokens))

    return run


def train(coded: DataFrame, vocabulary: Vocabulary, shared: object) -> tuple[Model, DataFrame, np.ndarray]:
    """Baum-Welch on every training text; (token, shape, found, states) of the words seen KEEP times or more; the last sums of classes.

    All PASSES take all texts, whole. shared: the vocabulary as a broadcast.
    """
    spark = coded.sparkSession
    unigram = vocabulary.unigram()
    texts = coded.where("not held_out")
    model = Model.random(unigram)
    add = [F.sum(s).alias(s) for s in _STATES]
    for n in range(PASSES):
        model_shared, last = spark.sparkContext.broadcast(model), n == PASSES - 1
        sums = texts.select("ids", "tail_shapes", *(["tail"] if last else [])).mapInArrow(_expect(model_shared, shared, by_word=last), _SUMS)
        sums = sums.groupBy("place", "token").agg(F.max("shape").alias("shape"), F.sum("found").alias("found"), *add)
        if last:
            sums = staged(sums.where(F.col("place").isNotNull() | (F.col("found") >= KEEP)), "hmm-states")
        expected = _gathered(sums)
        model = model.refitted(expected, unigram)
    return model, sums.where("place is null").drop("place"), expected


def shares_of(states: DataFrame, vocabulary: Vocabulary, expected: np.ndarray) -> Shares:
    """Spread and mass of the classes by shape: SHAPES rows reach the driver."""
    of_class = expected[1 + OWN : CLASSES] + ALPHA
    spread = of_class / of_class.sum(1, keepdims=True)
    summed = states.select("shape", "found", *_STATES).mapInArrow(_weights(spread), _WEIGHTS).groupBy("shape").agg(F.sum("found"), *[F.sum(s) for s in _STATES])
    rest, mass = vocabulary.totals.copy(), np.zeros((SHAPES, STATES))
    for shape, total, *weights in summed.collect():
        rest[shape] -= total
        mass[shape] = weights
    return Shares(spread, mass + np.maximum(rest, ALPHA)[:, None] * spread)


def known_emits(states: DataFrame, vocabulary: Vocabulary, shared: object, model: Model, shares: Shares) -> np.ndarray:
    """Emissions of the end and of the table's words. At most TABLE rows reach the driver."""
    v = vocabulary
    table = states.select("token", "found", *_STATES).mapInArrow(_of_table(shared), "token bigint, found bigint, " + ", ".join(f"{s} double" for s in _STATES)).toArrow()
    at = np.searchsorted(v.words, table.column("token").to_numpy().view(np.uint64))
    found, sums = np.zeros(len(v.words)), np.zeros((len(v.words), STATES))
    found[at] = table.column("found").to_numpy()
    for k, s in enumerate(_STATES):
        sums[at, k] = table.column(s).to_numpy()
    of_class = (v.counts + ALPHA)[:, None] * shares.emits(model, v.shapes, found, sums)
    return np.concatenate((model.emits[:1], np.where((v.own > 0)[:, None], model.emits[v.own], of_class)))


_PASSED = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "tail_log", "tail_known"]
_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, tail_log double, tail_known bigint, log_hidden double"


def _score(shared: object) -> Callable:
    """Columns: those that pass, then ids, tail_shapes, and of words outside the table that have states: place in the tail, number, states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares, known = shared.value

        def scores(held: _Held, sums: list[np.ndarray], found: list[np.ndarray]) -> np.ndarray:
            shapes = np.concatenate(held.shapes).astype(np.int64)
            emits = known
            if len(shapes):
                emits = np.concatenate((known, shares.emits(model, shapes, np.concatenate(found), np.concatenate(sums))))
            return log_likelihoods(model, held.sequences, emits)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held, sums, found, size, begin = _Held(len(known)), [], [], 0, at
                while at < batch.num_rows and (at == begin or held.n_tail < BATCH_TOKENS and size * (at - begin) <= 16 * BATCH_TOKENS):
                    shapes = batch.column("tail_shapes")[at].as_py()
                    held.sequences.append(held.take(np.frombuffer(batch.column("ids")[at].as_py(), np.int32), shapes))
                    size = max(size, len(held.sequences[-1]))
                    sums.append(np.zeros((len(shapes), STATES)))
                    found.append(np.zeros(len(shapes)))
                    places = batch.column("places")[at].values
                    if places is not None and len(places):
                        found[-1][places.to_numpy()] = batch.column("numbers")[at].values.to_numpy()
                        sums[-1][places.to_numpy()] = batch.column("states")[at].values.to_numpy().reshape(-1, STATES)
                    at += 1
                passed = {c: batch.column(c).slice(begin, at - begin) for c in _PASSED}
                yield rows(_SCORED, **passed, log_hidden=scores(held, sums, found))

    return run


def learn_vocabulary(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(token, shape, found) of every word of the training texts, and the bounded part that tasks get."""
    counted = docs.where("not held_out").mapInArrow(_count, _VOCABULARY)
    words = staged(counted.groupBy("token").agg(F.max("shape").alias("shape"), F.sum("found").alias("found")), "hmm-words")
    n_tokens, n_words, ends = words.agg(F.sum("found"), F.count("*"), F.sum(F.when(F.col("shape") < 0, F.col("found")))).first()
    # the most frequent words without a sort of all: as many eighths of powers of two of the count as fit in TABLE
    level = F.floor(F.log2("found") * 8)
    levels = words.where("shape >= 0").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # some hundred rows
    least, taken = None, 0
    for row in levels:
        if (taken := taken + row["count"]) > TABLE:
            break
        least = row["level"]
    table = words.where("shape >= 0").where(level >= least if least is not None else F.lit(False)).toArrow()  # TABLE rows at most
    tokens, found, shape = (table.column(c).to_numpy() for c in ("token", "found", "shape"))
    order = np.lexsort((tokens, -found))
    tokens, found, shape = tokens[order].view(np.uint64), found[order], shape[order]
    own = np.where(np.arange(len(tokens)) < OWN, np.arange(len(tokens)) + 1, 0)
    totals = np.full(SHAPES, ALPHA)
    for s, total, n in words.where("shape >= 0").groupBy("shape").agg(F.sum("found"), F.count("*")).collect():  # SHAPES rows
        mine = (shape == s) & (own > 0)
        totals[s] += total - found[mine].sum() + ALPHA * (n - mine.sum())
    order = np.argsort(tokens)
    return words, Vocabulary(tokens[order], found[order], shape[order], own[order], int(ends or 0), totals, int(n_tokens or 0), int(n_words or 0))


def scored(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0 (a null id counts as empty text) and scores all. base_score
    is the unigram score with 0.1 added to every count, score the model's log10 probability. Null and empty texts
    are one end token. Repeated rows are learned from and scored each for itself. An empty table gives no rows; with
    nothing to learn from, all words are unseen. Extra columns do not matter.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    docs = docs.select(F.col("doc_id").cast("bigint"), (fold == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    words, vocabulary = learn_vocabulary(docs)
    shared = spark.sparkContext.broadcast(vocabulary)
    coded = staged(docs.mapInArrow(_code(shared), _CODED), "hmm-coded")
    model, states, expected = train(coded, vocabulary, shared)
    shares = shares_of(states, vocabulary, expected)
    known = known_emits(states, vocabulary, shared, model, shares)

    # words outside the table find their counts and states by a join
    tail = coded.select("row", F.posexplode(F.arrays_zip("tail", "times")).alias("place", "x")).select("row", "place", F.col("x.tail").alias("token"), F.col("x.times").alias("times"))
    count = F.coalesce("found", F.lit(0))
    kept = states.select("token", F.struct(F.col("found").alias("n"), F.array(*_STATES).cast("array<float>").alias("s")).alias("kept"))
    tail = tail.join(words.select("token", "found"), "token", "left").join(kept, "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(count + ALPHA)).alias("tail_log"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("place", "kept.n", "kept.s"))).alias("kept"),
    )
    met = coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "ids", "tail_shapes").join(tail, "row", "left")
    met = met.select(*_PASSED, "ids", "tail_shapes", F.col("kept.place").alias("places"), F.col("kept.n").alias("numbers"), F.flatten("kept.s").alias("states"))
    out = met.mapInArrow(_score(spark.sparkContext.broadcast((model, shares, known))), _SCORED)
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    floor = float(np.log10(vocabulary.n_tokens + ALPHA * (vocabulary.n_words + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") + tail_log - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("log_hidden") + tail_log).alias("score"),
    )
