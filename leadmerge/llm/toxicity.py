"""Toxicity by compression distance: two zstandard dictionaries and a calibrated threshold."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from statistics import median_low

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from leadmerge.llm.common import in_fold, texts_of

#: Labelled rows per class that training may use, the first by a hash of their id.
SAMPLE = 3000
#: Bytes of ordinary and of toxic dictionary content.
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 16_384
#: Words are cut into windows of so many bytes.
WINDOW = 40
#: What a window has to share of the gain that a known one has before it counts; a known one counts 1.
BAR = 0.9
#: Windows whose gain a task remembers.
CACHE = 400_000
# Letters of any script make up words; everything else separates.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# A window stands between marks that both dictionaries know, so that short windows are
# compressed at all and every length counts the same fixed part.
_LEFT, _RIGHT = b"~{~ ", b" ~}~"
_HEAD, _TAIL = b"0123456789ABCDEFGHIJKLMN", b"OPQRSTUVWXYZ@#$%&*()[]{}"
_FRAME = b" " + _RIGHT + b" " + _LEFT + b" " + _TAIL + b" " + _HEAD + b" "


def windows(text: str) -> list[bytes]:
    """Lower-case words of the whole text, longer ones in pieces."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return [w if len(w) <= WINDOW else w[i : i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]


def _contexts(texts: list[str]) -> Counter:
    """How many different neighbourhoods a word has: copies of a text count once."""
    seen = set()
    for text in texts:
        words = windows(text)
        seen.update(zip([b"", *words], words, [*words[1:], b""]))
    return Counter(word for _, word, _ in seen)


def train_dictionaries(toxic: list[str], ordinary: list[str], *, bar: float = 4.5, lift: float = 6.0) -> tuple[bytes, bytes]:
    """Dictionary contents of ordinary and of toxic text.

    The ordinary one holds the words of ordinary text, the commonest last (nearest).
    The toxic one goes on with the words that toxic text uses ``lift`` times as often
    and ``bar`` standard deviations (by likelihood ratio) above chance, so that the two lengths of a window
    differ only by what toxic text adds.
    """
    bad, good = _contexts(toxic), _contexts(ordinary)
    n_bad, n_good = sum(bad.values()) + 1, sum(good.values()) + 1
    marked = []
    for word, n in bad.items():
        m = good[word]
        ratio = (n + 0.5) / n_bad * n_good / (m + 0.5)
        # Signed root of the likelihood ratio statistic.
        share = n_bad / (n_bad + n_good)
        z = math.sqrt(2 * max(0.0, n * math.log(n / ((n + m) * share)) + (m and m * math.log(m / ((n + m) * (1 - share))))))
        if ratio >= lift and z >= bar:
            marked.append((z, word))
    marked.sort(reverse=True)
    chosen, size = [], 0
    for _, word in marked:
        size += len(word) + len(_LEFT + _RIGHT)
        if size > TOXIC_BYTES:
            break
        chosen.append(word)
    known, size, common = set(chosen), 0, []
    for word, _ in sorted(good.items(), key=lambda x: (-x[1], x[0])):
        size += len(word) + 1
        if size > ORDINARY_BYTES:
            break
        if word not in known:
            common.append(word)
    base = b" " + b" ".join(reversed(common)) + b" "
    extra = b"".join(_LEFT + word + _RIGHT for word in reversed(chosen))
    return base + _FRAME, base + extra + _FRAME


class Distance:
    """What the toxic dictionary saves on the windows of a text against the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.same = ordinary == toxic
        self.ordinary, self.toxic = (self._compressor(d) for d in (ordinary, toxic))
        self.cache: dict[bytes, float] = {}
        if not self.same:
            added = toxic[len(ordinary) - len(_FRAME) : -len(_FRAME)]
            known = added[len(_LEFT) : -len(_RIGHT)].split(_RIGHT + _LEFT)
            #: Bytes of a window that the toxic dictionary knows whole.
            self.least = median_low(self._lengths(known)[1])

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            13, min_match=3, source_size=64, dict_size=len(content), write_content_size=0, write_dict_id=0
        )
        return zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)

    def _lengths(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        framed = [_HEAD + _TAIL + _LEFT + w + _RIGHT for w in words]
        a, b = (c.multi_compress_to_buffer(framed, threads=1) for c in (self.ordinary, self.toxic))
        return [len(x) for x in a], [len(x) for x in b]

    def gains(self, texts: list[str]) -> list[float]:
        """The gains of all windows of each text added up; 0 without windows.

        A window's gain is the saved share of the bytes that it takes beyond a known
        one: 1 for a short word as for a long one, if it is known. Only what is above
        ``BAR`` counts, so that parts of words do not add up in long texts.
        """
        if self.same:
            return [0.0] * len(texts)
        parts = [Counter(windows(t)) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = list({w for p in parts for w in p if w not in self.cache})
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for w, a, b in zip(some, *self._lengths(some)):
                share = min(1.0, (a - b) / max(3, a - self.least))
                self.cache[w] = max(0.0, (share - BAR) / (1 - BAR))
        cache = self.cache
        return [sum(n * cache[w] for w, n in p.items()) for p in parts]


def calibrate(gains: list[float], toxic: list[int], alarm_cost: float = 4.0) -> float:
    """The threshold on the gain with the least loss: share of toxic texts missed plus
    ``alarm_cost`` times the share of ordinary texts called toxic.

    Calling nothing toxic is among the choices, so a sample that separates nothing
    rejects nothing. Cuts lie midway between gains; of equally good ones the middle one.
    """
    bad = Counter(g for g, t in zip(gains, toxic) if t)
    good = Counter(g for g, t in zip(gains, toxic) if not t)
    n_bad, n_good = max(1, sum(bad.values())), max(1, sum(good.values()))
    levels = sorted({*gains, 0.0})
    cuts = [levels[0] - 0.5, *((a + b) / 2 for a, b in zip(levels, levels[1:])), levels[-1] + 0.5]
    lost = [
        sum(n for g, n in bad.items() if g < c) / n_bad + alarm_cost * sum(n for g, n in good.items() if g > c) / n_good
        for c in cuts
    ]
    least = min(lost)
    best = [c for c, x in zip(cuts, lost) if x == least]
    return best[len(best) // 2]


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE, steepness: float = 1.5,
) -> DataFrame:
    """``(id_col, held_out, score, predicted)``, one row per input row.

    Labels of rows outside the held-out fold train the model: at most ``sample`` rows
    per class, the first by a hash of the id; two thirds of them build the
    dictionaries, the rest set the threshold. Every text is then scored whole by what
    all its windows gain together. A null or empty text scores low; null ids are not held out and
    have no label; labels that are null or name no row are not used, of repeated ones
    the larger counts. Without labels of both classes every score is below 0.5. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~in_fold(F.col(id_col), folds, held_out))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .withColumn("h", F.xxhash64("id", F.lit(3)))
    )
    # Twice the sample: labels may name rows that are not there. A cut on the hash leaves
    # about twice as many again to be sorted, however many labels there are.
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}

    def first_by_hash(label: int) -> DataFrame:
        share = min(1.0, 4 * sample / sizes.get(label, 1))
        cut = -(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))
        return known.filter((F.col("toxic") == label) & (F.col("h") <= cut)).orderBy("h", "id").limit(2 * sample)

    picked = first_by_hash(1).unionAll(first_by_hash(0))
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
        .join(F.broadcast(picked), "id")  # at most four times the sample, ids only
        .dropDuplicates(["id"])
    )
    taken = rows.filter("toxic = 1").orderBy("h", "id").limit(sample).unionAll(
        rows.filter("toxic = 0").orderBy("h", "id").limit(sample)
    ).select("text", "toxic", (F.pmod("h", F.lit(3)) > 0).alias("builds")).collect()
    base, extra = train_dictionaries(
        [r.text for r in taken if r.builds and r.toxic == 1], [r.text for r in taken if r.builds and r.toxic == 0]
    )
    if {r.toxic for r in taken} != {0, 1}:
        extra = base
    rest = [r for r in taken if not r.builds] or taken
    threshold = calibrate(Distance(base, extra).gains([r.text for r in rest]), [r.toxic for r in rest]) if extra != base else 1.0
    shared = spark.sparkContext.broadcast((base, extra))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*shared.value)
        for batch in batches:
            gains = distance.gains(texts_of(batch, "text").to_pylist())
            scores = [1 / (1 + math.exp(min(50.0, max(-50.0, steepness * (threshold - g))))) for g in gains]
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column("id"), "held_out": batch.column("held_out"),
                "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), in_fold(F.col(id_col), folds, held_out).alias("held_out")
    ).mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
