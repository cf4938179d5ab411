"""Toxicity scores of texts whose words may be disguised.

A writer's word goes through a noisy channel: letters become look-alike signs
("1d10t"), signs or blanks come between them ("i.d.i.o.t", "i d i o t"), letters
are repeated ("idiiiot"). The channel is undone before scoring:

1. A character language model (interpolated trigrams, counted over all texts)
   says how likely a spelling is.
2. Each run of signs that may be disguised is a lattice: a sign may stand for a
   letter, be dropped or end a word; a repeated letter may be one; a blank
   between single letters may be dropped. The Viterbi path, the likeliest
   reading under channel and language model together, takes the run's place.
   All other text stays as it is.
3. The restored text is scored by logistic regression on its words and word
   beginnings, each with how often it occurs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierlab.llm import text as tx
from carrierlab.llm.tables import checkpointed

DIMENSIONS, BEGINNINGS, TIMES = 1 << 20, (4, 5, 7), (1, 2, 3, 5)
SAMPLE, FOLDS, MIN_DOCS, CHOSEN = 16384, 5, 8, 2048
EPOCHS, RATE, DECAY, BATCH, FALSE_COST = 10, 0.3, 1e-3, 128, 5.0

# Letter classes: 0 ends a word, 1 to 26 are a to z, then the bytes from 128 on.
CLASSES = 27 + 128
CLASS = np.zeros(256, dtype=np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = np.arange(27, CLASSES)

# Signs and the letters they are written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# Costs (negative log probabilities) of the channel's steps.
AS_LETTER, SIGN_GONE, SIGN_ENDS, REPEAT_GONE, BLANK_GONE, BLANK_ENDS = 1.0, 8.0, 9.0, 2.0, 0.5, 2.5
OTHER_GONE, OTHER_ENDS = 0.5, 2.5
CACHE = 1 << 17

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in LOOKALIKES if ord(c) < 128]] = True


@dataclass
class Spelling:
    """Interpolated trigram model of words: counts by number, tables made where they are used."""

    numbers: np.ndarray
    counts: np.ndarray
    _cost: dict = field(default_factory=dict)
    _tables: tuple | None = None
    _read: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"numbers": self.numbers, "counts": self.counts}

    def __setstate__(self, state):
        self.__init__(**state)

    def _prepare(self):
        tri = dict(zip(self.numbers.tolist(), self.counts.tolist()))
        bi, pair, uni, after = {}, {}, {}, {}
        for number, n in tri.items():
            a, b, c = number // CLASSES ** 2, number // CLASSES % CLASSES, number % CLASSES
            pair[a, b] = pair.get((a, b), 0) + n
            bi[b, c] = bi.get((b, c), 0) + n
            after[b] = after.get(b, 0) + n
            uni[c] = uni.get(c, 0) + n
        self._tables = tri, pair, bi, after, uni, max(sum(uni.values()), 1)

    def cost(self, a: int, b: int, c: int) -> float:
        """-log P(c | a, b)."""
        key = (a * CLASSES + b) * CLASSES + c
        if key not in self._cost:
            if self._tables is None:
                self._prepare()
            tri, pair, bi, after, uni, total = self._tables
            low = (uni.get(c, 0) + 1e-3) / (total + 1e-3 * CLASSES)
            n = after.get(b, 0)
            low = (bi.get((b, c), 0) + 8 * low) / (n + 8)
            n = pair.get((a, b), 0)
            self._cost[key] = -math.log((tri.get(key, 0) + 8 * low) / (n + 8))
        return self._cost[key]

    def reading(self, written: str) -> str:
        """Likeliest lower-case spelling of a run of signs (Viterbi over the lattice)."""
        done = self._read.get(written)
        if done is None:
            if len(self._read) >= CACHE:
                self._read.clear()
            done = self._read[written] = self._viterbi(written)
        return done

    def _viterbi(self, written: str) -> str:
        # A node: the last two classes that were read, and the last letter for repeats.
        nodes = {(0, 0): (0.0, None)}
        before = ""

        def gone(cost):
            for node, (value, path) in nodes.items():
                keep(node, value + cost, path)

        def ends(cost):
            for (a, b), (value, path) in nodes.items():
                keep((0, 0), value + cost + (self.cost(a, b, 0) if b else 0.0), (path, " ") if b else path)

        def reads(letters, cost):
            for (a, b), (value, path) in nodes.items():
                value += cost
                for byte in letters.encode():
                    c = int(CLASS[byte])
                    value += self.cost(a, b, c)
                    a, b = b, c
                keep((a, b), value, (path, letters))

        for sign in written:
            fresh: dict = {}

            def keep(node, value, path, fresh=fresh):
                if node not in fresh or value < fresh[node][0]:
                    fresh[node] = (value, path)

            if sign.isspace():
                gone(BLANK_GONE)
                ends(BLANK_ENDS)
            elif sign in LOOKALIKES:
                for letter in LOOKALIKES[sign]:
                    reads(letter, AS_LETTER)
                gone(SIGN_GONE)
                ends(SIGN_ENDS)
            elif sign.isalpha():
                reads(sign, 0.0)
                if sign == before:
                    gone(REPEAT_GONE)
            else:
                gone(OTHER_GONE)
                ends(OTHER_ENDS)
            before = sign
            nodes = fresh
        (_, path) = min(((value + (self.cost(a, b, 0) if b else 0.0), path) for (a, b), (value, path) in nodes.items()),
                        key=lambda x: x[0])
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))


def spelling(docs: DataFrame) -> Spelling:
    """The language model of all texts; a table of at most CLASSES^3 counts reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, dtype=np.int64)
        for _, data, offsets in tx.slices(batches, "text"):
            # Texts are parted by a blank; runs of other signs count as one.
            c = np.insert(CLASS[data], offsets, 0)
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
            if len(c) < 2:
                continue
            a, b, c = np.concatenate([[0], c[:-2]]), c[:-1], c[1:]
            a = np.where(b == 0, 0, a)
            total += np.bincount((a * CLASSES + b) * CLASSES + c, minlength=CLASSES ** 3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["number", "n"])

    table = docs.select("text").mapInArrow(count, "number long, n long").groupBy("number").agg(
        F.sum("n").alias("n")).orderBy("number").toArrow()
    return Spelling(table.column("number").to_numpy(), table.column("n").to_numpy())


def suspects(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Spans that may be disguised words, in order, not overlapping.

    A run without blanks is one if a look-alike sign stands beside a letter, a
    letter comes three times in a row, or single letters alternate with other
    signs; so are three and more single letters or look-alikes in a row, parted
    by blanks.
    """
    starts, ends = tx.word_spans(data, offsets)
    if not len(starts):
        return []
    low = tx.LOWER[data]
    letter, sign = _LETTER[data], _SIGN[data]
    beside = np.zeros(len(data) + 1, dtype=np.int64)
    hit = np.zeros(len(data), dtype=bool)
    hit[1:] = sign[1:] & letter[:-1]
    hit[:-1] |= sign[:-1] & letter[1:]
    triple = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] < 128)
    hit[2:] |= triple
    np.cumsum(hit, out=beside[1:])
    # Letter, other sign, letter, other sign, letter.
    odd = ~letter & ~tx.SPACE[data]
    part = np.zeros(len(data), dtype=bool)
    if len(data) > 4:
        part[4:] = letter[4:] & odd[3:-1] & letter[2:-2] & odd[1:-3] & letter[:-4]
    parted = np.concatenate([[0], np.cumsum(part)])
    # Runs of single signs: code points of one byte, or of a lead byte and one more.
    bad = (beside[ends] > beside[starts]) | (parted[ends] > parted[np.minimum(starts + 4, ends)])
    single = ((ends - starts == 1) | ((ends - starts == 2) & (data[starts] >= 0xC2) & (data[starts] < 0xE0))) & (
        letter[starts] | sign[starts])
    owner = np.searchsorted(offsets, starts, side="right")
    joined = np.zeros(len(starts), dtype=bool)
    final = single | ((ends - starts == 2) & letter[starts] & np.isin(data[ends - 1], list(_CLOSING)))
    joined[1:] = final[1:] & single[:-1] & (owner[1:] == owner[:-1]) & (starts[1:] - ends[:-1] <= 3)
    run = np.cumsum(~joined)
    size = np.bincount(run)
    spaced = size[run] >= 3
    # Signs around a word, as in "(No!)", are no disguise.
    out, last = [], -1
    for k in np.flatnonzero(bad | spaced):
        if spaced[k]:
            if run[k] != last:
                last = int(run[k])
                end = k + int(size[last]) - 1
                out.append((int(starts[k]), int(ends[end]) - (not single[end])))
        else:
            start, end = int(starts[k]), int(ends[k])
            while end > start and data[end - 1] in _CLOSING:
                end -= 1
            while end > start and data[start] in _OPENING:
                start += 1
            if beside[end] > beside[start] or parted[end] > parted[min(start + 4, end)]:
                out.append((start, end))
    return out


_CLOSING, _OPENING = frozenset(b"!?.,;:)"), frozenset(b"(")


def restored(data: np.ndarray, offsets: np.ndarray, model: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes and offsets of the texts with each suspect span replaced by its likeliest reading."""
    low = tx.LOWER[data]
    spans = suspects(data, offsets)
    if not spans:
        return low, offsets
    pieces, shift, at, places, changes = [], 0, 0, [], []
    for start, end in spans:
        written = low[start:end].tobytes().decode("utf-8", "replace")
        read = model.reading(written).encode()
        pieces.append(low[at:start])
        pieces.append(np.frombuffer(read, dtype=np.uint8))
        at = end
        shift += len(read) - (end - start)
        places.append(start)
        changes.append(shift)
    pieces.append(low[at:])
    before = np.searchsorted(np.array(places), offsets, side="left")
    return np.concatenate(pieces), offsets + np.concatenate([[0], np.array(changes)])[before]


def features(low: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, slot), sorted: words and word beginnings, by how often they occur.

    ``wanted`` tells which base slots can matter; others are left out before sorting.
    """
    letter = _LETTER[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last[:-1] &= ~letter[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    owners, bases = [owner], [tx.span_hashes(low, starts, ends)]
    for size in BEGINNINGS:
        some = ends - starts > size
        owners.append(owner[some])
        bases.append(tx.mix(tx.span_hashes(low, starts[some], starts[some] + size), size))
    if wanted is not None:
        for k, base in enumerate(bases):
            some = wanted[base % np.uint64(DIMENSIONS)]
            owners[k], bases[k] = owners[k][some], base[some]
    owner, base = np.concatenate(owners), np.concatenate(bases)
    order = np.lexsort((base, owner))
    owner, base = owner[order], base[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (base[1:] != base[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(owner)))
    owner, base = owner[at], base[at]
    return tx.distinct_sorted(np.concatenate([owner[times >= t] for t in TIMES]), np.concatenate(
        [_slot(base[times >= t] % np.uint64(DIMENSIONS), k) for k, t in enumerate(TIMES)]))


def _slot(base: np.ndarray, level: int) -> np.ndarray:
    return base.astype(np.uint64) * np.uint64(len(TIMES)) + np.uint64(level)


@dataclass
class Model:
    spelling: Spelling
    slots: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        wanted = np.zeros(DIMENSIONS, dtype=bool)
        wanted[(self.slots // len(TIMES)).astype(np.int64)] = True
        owner, slot = features(*restored(data, offsets, self.spelling), wanted)
        at = np.searchsorted(self.slots, slot)
        at[at == len(self.slots)] = 0
        weight = np.where(self.slots[at] == slot, self.weights[at], 0.0) if len(self.slots) else np.zeros(len(slot))
        sums = self.bias + np.bincount(owner, weights=weight, minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(sums, -60, 60)))


def _prior(y: np.ndarray) -> float:
    share = min(max(y.mean() if len(y) else 0.5, 0.001), 0.999)
    return math.log(share / (1 - share))


def _logistic(rows: list[np.ndarray], y: np.ndarray, width: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """Adaptive gradient descent on the logistic loss, with decay."""
    weights, squares = np.zeros(width), np.full(width, 1e-8)
    bias, bias_squares = _prior(y), 1e-8
    random = np.random.default_rng(seed)
    for _ in range(EPOCHS if len(y) else 0):
        order = random.permutation(len(y))
        for low in range(0, len(order), BATCH):
            batch = order[low: low + BATCH]
            at = np.concatenate([rows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            z = bias + np.bincount(row, weights=weights[at], minlength=len(batch))
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[batch]) / len(batch)
            g = np.bincount(at, weights=error[row], minlength=width) + DECAY * weights
            squares += g * g
            weights -= RATE * g / np.sqrt(squares + 1e-4)
            g = float(error.sum())
            bias_squares += g * g
            bias -= 0.1 * g / math.sqrt(bias_squares + 1e-4)
    return weights, bias


def _sums(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([bias + weights[r].sum() for r in rows])


def _cut(sums: np.ndarray, y: np.ndarray) -> float:
    """Where caught toxic texts minus FALSE_COST times clean ones taken along, as shares, is greatest."""
    if not (y == 1).any() or not (y == 0).any():
        return 0.0
    order = np.argsort(-sums, kind="stable")
    gain = np.cumsum(np.where(y[order] == 1, 1 / (y == 1).sum(), -FALSE_COST / (y == 0).sum()))
    sums = sums[order]
    last = np.append(sums[1:] < sums[:-1], True)  # equal sums fall on one side
    best = int(np.argmax(np.where(last, gain, -np.inf)))
    if gain[best] <= 0:
        return 0.0
    return float((sums[best] + (sums[best + 1] if best + 1 < len(sums) else sums[best] - 1)) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """Model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Labels of ids whose crc32 is divisible by ``folds`` are never read. Of the
    others at most ``sample`` ids are used, those of least hash, with one text
    each; the language model counts all texts. Slots are chosen by likelihood
    ratio on the sample; the cut at score 0.5 is set on one fold of it, by a
    model of the rest.
    """
    spelled = spelling(docs)
    rated = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    least = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text"))
    single = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(
        least.alias("least")).select("doc_id", "toxic", "least.text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tx.slices(batches, "text"):
            owner, slot = features(*restored(data, offsets, spelled))
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), lists],
                                             names=["doc_id", "toxic", "slots"])

    rows = checkpointed(single.mapInArrow(extract, "doc_id long, toxic int, slots array<int>"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(DIMENSIONS * len(TIMES), dtype=np.int32) for _ in range(2)]
        for batch in batches:
            size = np.diff(batch.column("slots").offsets.to_numpy())
            toxic = np.repeat(batch.column("toxic").to_numpy(), size)
            slots = batch.column("slots").flatten().to_numpy()
            for k in range(2):
                found[k] += np.bincount(slots[toxic == k], minlength=len(found[k])).astype(np.int32)
        some = np.flatnonzero(found[0] + found[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[0][some].astype(np.int64)),
                                          pa.array(found[1][some].astype(np.int64))], names=["slot", "clean", "toxic"])

    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    all_clean, all_toxic = sizes.get(0, 0), sizes.get(1, 0)
    n = max(all_clean + all_toxic, 1)

    def term(seen, margin):  # seen * log(seen / expected)
        expected = (F.col("clean") + F.col("toxic")) * margin / n
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    table = rows.mapInArrow(count, "slot int, clean long, toxic long").groupBy("slot").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= MIN_DOCS)
    ratio = term(F.col("toxic"), max(all_toxic, 1)) + term(F.col("clean"), max(all_clean, 1))
    # Marks of toxic texts only: what is common in clean ones tells of the corpus.
    slots = np.sort(np.array([r.slot for r in table.where(
        F.col("toxic") * all_clean > F.col("clean") * all_toxic).orderBy(F.desc(ratio), "slot").limit(CHOSEN).collect()],
        dtype=np.int64))
    held = frozenset(slots.tolist())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.searchsorted(slots, [s for s in row if s in held]).astype(np.int32)
                     for row in batch.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"),
                                              pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "toxic", "slots"])

    known = rows.mapInArrow(keep, "doc_id long, toxic int, slots array<int>").toArrow().sort_by("doc_id")
    marks = [np.asarray(x.values).astype(np.int64) for x in known.column("slots")]
    y = known.column("toxic").to_numpy().astype(np.int64)
    fold = np.arange(len(y)) % 4 == 0
    rest = np.flatnonzero(~fold)
    weights, bias = _logistic([marks[i] for i in rest], y[rest], len(slots))
    cut = _cut(_sums([marks[i] for i in np.flatnonzero(fold)], weights, bias), y[fold])
    weights, bias = _logistic(marks, y, len(slots))
    # A text without marks is never likelier to be toxic than any text.
    return Model(spelled, slots.astype(np.uint64), weights, min(bias - cut, _prior(y)))


def score(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text counts. Null and empty texts have no marks and get the score
    of the model's bias; a null id counts as held out. Texts are read whole, a
    bounded number at a time; ids may repeat, extra columns are ignored, an
    empty table gives an empty result. Without labels of both kinds all scores
    follow the share of toxic labels (one half without any).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tx.slices(batches, "text"):
            value = model.score(data, offsets).round(9)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), pa.array(value),
                pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
