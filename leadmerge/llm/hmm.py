"""Hidden Markov language model: Baum-Welch over all partitions, exact forward scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leadmerge.llm.common import in_fold, most_frequent, sent, stage, texts_of, word_lists

#: Latent states and rounds of Baum-Welch.
STATES, ROUNDS = 8, 4
#: Words with an emission of their own; the others emit through a class of their ending.
OWN_WORDS, ENDINGS = 32_768, 256
#: Words whose counts are broadcast; counts of the others are joined.
COUNTED_WORDS = 262_144
#: Type of a class in a sequence.
CODE = np.min_scalar_type(OWN_WORDS + ENDINGS)
#: Training cuts long texts into pieces; scoring does not.
PIECE = 256
#: Texts whose recursions run side by side, and time steps gathered at once.
SIDE, STEPS = 512, 256
#: Steps from one scaling of the recursions to the next; so many emissions are far from underflow.
SCALED = 4
ONES = np.ones(STATES)


@dataclass
class Lexicon:
    """Counts of the most frequent words, and classes of all words. Sizes are bounded."""

    words: pa.Array
    counts: np.ndarray
    total: int  # training tokens, ends included
    distinct: int
    ends: int
    ending_tokens: np.ndarray  # tokens and distinct words per ending, of words without own emission
    ending_words: np.ndarray

    @property
    def own(self) -> int:
        return min(OWN_WORDS, len(self.words))

    @property
    def classes(self) -> int:
        return self.own + ENDINGS + 1

    def class_counts(self) -> np.ndarray:
        """Training tokens per class: own words, endings, end of text."""
        return np.concatenate([self.counts[: self.own], self.ending_tokens, [self.ends]]).astype(float)

    def log_in_ending(self) -> np.ndarray:
        """-log10 of the denominator of a word's probability inside its ending's class."""
        return -np.log10(self.ending_tokens + 0.5 * (self.ending_words + 1))

    def log_base(self) -> float:
        return -np.log10(self.total + 0.5 * (self.distinct + 1))


def endings(words: pa.Array) -> np.ndarray:
    """Classes of the words' last three characters (crc32, as in SQL)."""
    last = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    classes = np.array([zlib.crc32(e.encode()) % ENDINGS for e in last.dictionary.to_pylist()], np.int32)
    return classes[last.indices.to_numpy()]


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts of ``rows(text)``; added up per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, words = word_lists(texts_of(batch, "text"))
            found = words.dictionary_encode()
            c = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)) if len(words) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"word": found.dictionary.cast(pa.string()), "c": pa.array(c.astype(np.int64))})

    return rows.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    top = most_frequent(counts, "c", COUNTED_WORDS).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = pa.concat_arrays(top["word"].chunks) if top.num_rows else pa.array([], pa.string())
    own = words.slice(0, OWN_WORDS)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    group = F.crc32(F.substring("word", -3, 3).cast("binary")) % ENDINGS
    by_ending = counts.groupBy(group.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    tokens, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    tokens[by_ending["e"].to_numpy()] = by_ending["n"].to_numpy()
    kinds[by_ending["e"].to_numpy()] = by_ending["v"].to_numpy()
    c = top["c"].to_numpy()
    np.subtract.at(tokens, endings(own), c[: len(own)])
    np.subtract.at(kinds, endings(own), 1)
    return Lexicon(words, c, int(sums["n"] or 0) + texts, int(sums["v"]) + (texts > 0), texts, tokens, kinds)


class Encoder:
    """Texts as class sequences, each closed by the end of text."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.listed_class = np.arange(len(lex.words), dtype=np.int32)
        self.listed_class[lex.own :] = lex.own + endings(lex.words.slice(lex.own))

    def encode(self, texts: pa.Array):
        """Sequence offsets and classes, and per word: its text, dictionary index and the dictionary."""
        lex = self.lex
        offsets, words = word_lists(texts)
        coded = words.dictionary_encode()
        names = coded.dictionary
        listed = pc.index_in(names, value_set=lex.words).fill_null(-1).to_numpy().astype(np.int64)
        kind = np.where(listed >= 0, self.listed_class[listed] if len(lex.words) else 0, 0).astype(np.int32)
        unlisted = np.flatnonzero(listed < 0)
        kind[unlisted] = lex.own + endings(names.take(pa.array(unlisted)))
        index = coded.indices.to_numpy()
        lengths = np.diff(offsets)
        sequence = np.full(len(index) + len(lengths), lex.classes - 1, CODE)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sequence[np.arange(len(index)) + owner] = kind[index]
        return offsets + np.arange(len(offsets)), sequence, owner, index, names, listed


def packed(offsets: np.ndarray, sequence: np.ndarray) -> pa.Array:
    """Class sequences as one binary column."""
    offsets = pa.array((offsets * CODE.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, offsets.buffers()[1], pa.py_buffer(sequence)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sequence offsets and classes of a column made by :func:`packed`."""
    column = pa.concat_arrays([column])  # offsets from 0
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[: len(column) + 1].astype(np.int64) // CODE.itemsize
    return offsets, np.frombuffer(data, CODE)[: offsets[-1]]


class Model:
    """Start, transition and emission probabilities; emissions by (class, state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, lex: Lexicon, seed: int = 17) -> Model:
        """States differ in which endings they prefer and rarely change."""
        rng = np.random.default_rng(seed)
        taste = rng.uniform(0.2, 1.8, (ENDINGS, STATES))
        classes = np.concatenate([endings(lex.words.slice(0, lex.own)), np.arange(ENDINGS)])
        counts = lex.class_counts() + 0.5
        emit = counts[:, None] * np.concatenate([taste[classes], np.ones((1, STATES))])
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, lex: Lexicon, prior: float = 2000.0) -> Model:
        """Expected counts, smoothed by the frequencies of the classes."""
        counts = lex.class_counts() + 0.5
        emit = emit + prior * (counts / counts.sum())[:, None]
        move = move + 1.0
        start = start + 1.0
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def log10(self, offsets: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """Exact log10 probability of every class sequence by the scaled forward recursion."""
        lengths = np.diff(offsets)
        out = np.zeros(len(lengths))
        order = np.argsort(-lengths, kind="stable")
        for i in range(0, len(order), SIDE):
            some = order[i : i + SIDE]
            begin, size = offsets[some], lengths[some]
            state = np.tile(self.start, (len(some), 1))
            moved = state.copy()
            log = np.zeros(len(some))
            for t0 in range(0, int(size[0]), STEPS):
                steps = np.arange(t0, min(t0 + STEPS, int(size[0])))
                alive = np.searchsorted(-size, -steps, side="left")  # longer than the step
                at = np.minimum(begin[: alive[0]] + steps[:, None], len(sequence) - 1)
                emit = self.emit[sequence[at]]
                scales = np.ones((len(steps), alive[0]))
                for t, n in enumerate(alive.tolist()):
                    if t0 + t:
                        np.matmul(state[:n], self.move, out=moved[:n])
                    np.multiply(moved[:n], emit[t, :n], out=state[:n])
                    if t % SCALED == SCALED - 1:
                        np.matmul(state[:n], ONES, out=scales[t, :n])
                        state[:n] /= scales[t, :n, None]
                log[: alive[0]] += np.log10(scales[SCALED - 1 :: SCALED]).sum(axis=0)
            out[some] = log + np.log10(state.sum(axis=1))
        return out


class Counts:
    """Expected counts of one task."""

    def __init__(self, model: Model):
        self.model = model
        self.start = np.zeros(STATES)
        self.move = np.zeros((STATES, STATES))
        self.emit = np.zeros_like(model.emit)

    def add(self, offsets: np.ndarray, sequence: np.ndarray) -> None:
        """Forward-backward over pieces of the sequences."""
        lengths = np.diff(offsets)
        pieces = -(-lengths // PIECE)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][owner] + place * PIECE
        size = np.minimum(PIECE, offsets[1:][owner] - begin)
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), SIDE):
            some = order[i : i + SIDE]
            self._block(sequence, begin[some], size[some])

    def _block(self, sequence: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        m, b, t_max = self.model, len(begin), int(size[0])
        alive = np.searchsorted(-size, -np.arange(t_max), side="left").tolist()  # longer than the step
        at = np.minimum(begin + np.arange(t_max)[:, None], len(sequence) - 1)
        kinds = sequence[at]
        emit = m.emit[kinds]
        alpha = np.zeros((t_max, b, STATES))
        scale = np.ones((t_max, b))
        alpha[0] = m.start * emit[0]
        for t in range(1, t_max):
            n = alive[t]
            np.matmul(alpha[t - 1, :n], m.move, out=alpha[t, :n])
            alpha[t, :n] *= emit[t, :n]
            if t % SCALED == SCALED - 1:
                np.matmul(alpha[t, :n], ONES, out=scale[t, :n])
                alpha[t, :n] /= scale[t, :n, None]
        # From the end of each piece, where the sum of alpha is what no scale has taken yet.
        beta = np.empty_like(alpha)
        beta[:] = 1 / alpha[size - 1, np.arange(b)].sum(axis=1)[:, None]
        back = m.move.T.copy()
        for t in range(t_max - 1, 0, -1):
            n = alive[t]
            later = emit[t]  # from here on emission times beta, zero behind the end
            later[:n] *= beta[t, :n]
            later[n:] = 0
            if t % SCALED == SCALED - 1:
                later[:n] /= scale[t, :n, None]
            np.matmul(later[:n], back, out=beta[t - 1, :n])
        self.move += alpha[:-1].reshape(-1, STATES).T @ emit[1:].reshape(-1, STATES) * m.move
        alpha *= beta  # now the posterior of the state, zero behind the end
        self.start += alpha[0].sum(axis=0)
        flat = kinds.ravel()
        for k, weights in enumerate(alpha.reshape(-1, STATES).T):
            self.emit[:, k] += np.bincount(flat, weights=weights, minlength=len(self.emit))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(place, n0, n1, ...): emissions from 0, then transitions, then the start."""
        table = np.concatenate([self.emit, self.move, self.start[None]])
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_pydict(
            {"place": pa.array(some.astype(np.int32))} | {f"n{k}": pa.array(table[some, k]) for k in range(STATES)}
        )


def encoded(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """Every text of ``rows(id, text, held_out)`` as its class sequence, and all that needs its words.

    ``base`` and ``known`` lack the words in ``rare``, whose counts are not here; ``inside``
    is what the words add to the probability of their classes, again without ``rare``.
    """
    shared = sent(rows.sparkSession, lex)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared()
        encoder = Encoder(lex)
        inside, base = lex.log_in_ending(), lex.log_base()
        listed_log = np.log10(lex.counts + 0.5)
        end = np.log10(lex.ends + 0.5) + base
        for batch in batches:
            offsets, sequence, owner, index, names, listed = encoder.encode(texts_of(batch, "text"))
            m = batch.num_rows
            place = listed[index]
            known = place >= 0
            log = np.where(known, listed_log[place] if len(listed_log) else 0.0, 0.0)
            n_tokens = np.diff(offsets)
            sums = lambda values: np.bincount(owner, weights=values, minlength=m)
            kind = sequence[np.arange(len(index)) + owner].astype(np.int64)
            by_ending = kind >= lex.own
            part = np.where(by_ending, inside[np.where(by_ending, kind - lex.own, 0)] + log, 0.0)
            # Words whose count is not here: distinct ones per text, looked up by a join.
            rest = np.flatnonzero(~known)
            pairs, times = np.unique(owner[rest] * len(names) + index[rest], return_counts=True)
            bounds = np.searchsorted(pairs // max(1, len(names)), np.arange(m + 1)).astype(np.int32)
            rare = pa.StructArray.from_arrays(
                [names.take(pa.array(pairs % max(1, len(names)))), pa.array(times.astype(np.int64))], ["word", "times"]
            )
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(n_tokens),
                "n_known": pa.array((sums(known.astype(float)) + (lex.ends > 0)).astype(np.int64)),
                "base": pa.array(sums(log) + base * (n_tokens - 1) + end), "inside": pa.array(sums(part)),
                "sequence": packed(offsets, sequence), "rare": pa.ListArray.from_arrays(pa.array(bounds), rare),
            })

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        encode,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, inside double, sequence binary,"
        " rare array<struct<word:string,times:long>>",
    )


def train(rows: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over ``rows(sequence)``: every round adds up the expected counts of all partitions.

    A task sends one row per class it met; the sums (own words, endings and states,
    all of fixed number) come to the driver, which makes the next model.
    """
    model = Model.initial(lex)
    if not lex.total:
        return model
    columns = ", ".join(f"n{k} double" for k in range(STATES))
    for _ in range(rounds):
        shared = sent(rows.sparkSession, model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = Counts(shared())
            for batch in batches:
                counts.add(*unpacked(batch.column("sequence")))
            yield from counts.rows()

        sums = rows.mapInArrow(expect, f"place int, {columns}").groupBy("place").agg(
            *[F.sum(f"n{k}").alias(f"n{k}") for k in range(STATES)]
        ).toArrow()
        table = np.zeros((lex.classes + STATES + 1, STATES))
        table[sums["place"].to_numpy()] = np.stack([sums[f"n{k}"].to_numpy() for k in range(STATES)], 1)
        model = Model.from_counts(table[-1], table[-1 - STATES : -1], table[: lex.classes], lex)
    return model


def hmm_scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1, rounds: int = ROUNDS
) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    Tokens are the lower-case (A-Z) words between ASCII white space and one end per
    text. The model learns from the texts outside the held-out fold, all of them in
    every round; ``score`` is the exact log10 probability of the whole text under it:
    a word has an emission of its own or that of its ending times its smoothed share
    in the ending's class. ``base_score`` is the smoothed unigram score with the same
    counts. Null and empty texts consist of their end. A null id is not held out.
    Repeated rows count as often as they stand. Without training texts the model is
    uniform over endings. Other columns are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), in_fold(F.col(id_col), folds, held_out).alias("held_out")
    )
    training = rows.filter("not held_out").select("text")
    counts = stage(word_counts(training), "words")
    lex = lexicon(counts, training.count())
    # The texts are cut into words twice, here and to count them; all rounds and scores read the sequences.
    sequences = stage(encoded(rows, lex).withColumn("row", F.monotonically_increasing_id()), "sequences")
    shared = sent(spark, train(sequences.filter("not held_out").select("sequence"), lex, rounds))

    kept = sequences.drop("rare", "sequence", "inside").schema
    names = kept.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            log = model.log10(*unpacked(batch.column("sequence")))
            yield batch.select(names).append_column("score", pa.array(log + batch.column("inside").to_numpy()))

    scored = stage(sequences.drop("rare").mapInArrow(score, StructType([*kept, StructField("score", DoubleType())])), "scored")
    c = F.coalesce("c", F.lit(0))
    looked_up = (
        sequences.select("row", F.inline("rare")).join(counts, "word", "left")
        .groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    )
    log = F.coalesce("log", F.lit(0.0))
    return scored.join(looked_up, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
