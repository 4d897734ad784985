"""Language-model scores by Brown class bigrams.

P(text) is the product of class-transition and word-emission probabilities. Words are assigned to
CLASSES classes by exchange clustering: a word moves to the class in which the likelihood of the class
bigrams is highest. It runs in three tiers, so that nothing but bounded tables meets in one place:

1. The CLUSTERED most frequent words are exchanged one after the other on their bigram counts, until
   none moves. This sets up the classes.
2. The HEAD most frequent words are exchanged in rounds: a distributed pass over all training texts
   counts the classes before and after each word, then the words move, half of them in a round so that
   neighbours do not change places; ROUNDS times, or until two rounds gain less than GAIN of the likelihood.
3. Every other word that occurs twice or more makes its move by its own bigrams, in a table.

Words that occur once, which stand for those never seen, are in classes of their surface form; the
end of a text is a class of its own and also what a text begins from.

All counts (words, class bigrams, words by class) are taken over all training documents. Counts and
classes of the HEAD most frequent words are broadcast (a bounded number of bounded words); those of the
other words stay a table and are joined with the words of the texts, once for each text and word.

Defined results: a null or empty text is the end token alone; documents whose key is null are learned
from; without training documents every count is 0, so that the base score is 0; repeated rows are
scored (and learned from) as often as they occur; of equally frequent words a hash decides which are in the
head; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bound_batches, drop_table, fold, stage_table

FOLDS, HELD_OUT = 7, 2
CLUSTERED, CLASSES = 1024, 48
#: Words whose counts are broadcast (with forms and the end they have numbers of 16 bits), and the longest of them in
#: bytes; longer ones are in the table of the other words.
HEAD, HEAD_BYTES = 50_000, 64
#: Rounds of exchange at most; tokens that a worker counts at once; words whose counts are one row.
ROUNDS, AT_ONCE, BLOCK = 3, 1_000_000, 512
#: Clustered words whose bigram counts are one row.
PAIR_BLOCK = 32
#: Share of the likelihood that two rounds have to gain for a further one.
GAIN = 1e-3
#: Added to a word's count within its class, and the weight of the class distribution in a transition.
DELTA, BETA = 0.5, 20.0
#: Words that a worker counts or remembers before it passes them on or forgets them.
HELD_WORDS = 120_000
#: Bigrams of a word that a worker passes on one by one; more are passed on as gains. Bigrams that a worker holds.
SINGLE, HELD_BIGRAMS = 32, 2_000_000
#: Surface classes: three endings x two alphabets x three lengths.
FORMS = 18


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # of bytes: A-Z only, and exactly the white space of the contract


def form_of(word: bytes) -> int:
    last = word[-1]
    ending = 0 if 97 <= last <= 122 or last >= 128 else 1 if last in b".,;:!?" else 2
    return ending * 6 + (0 if word.isascii() else 3) + (0 if len(word) <= 4 else 1 if len(word) <= 8 else 2)


class _Ids(dict):
    """Word -> number; words that are not listed get ``first`` + their form, remembered up to a bound."""

    def __init__(self, listed: dict[bytes, int], first: int):
        super().__init__(listed)
        self.listed, self.first = listed, first

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.listed) + HELD_WORDS:
            self.clear()
            self.update(self.listed)
        self[word] = k = self.listed.get(word, self.first + form_of(word))
        return k


# ---------------------------------------------------------------- counts, over all training documents


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for b in batches:
        for t in b.column(0):
            if t.is_valid:
                held.update(words_of(t.as_py()))
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def _number(listed: dict[bytes, int]):
    """Texts (the first column) as numbers of words, forms and the end, 16 bits each; each text ends with the end. Besides,
    the words that have only the number of their form, and the other columns as they are."""
    first = len(listed)
    end = np.array([first + FORMS], "<u2").tobytes()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(listed, first)
        for b in batches:
            rows, rest = [], []
            for t in b.column(0):
                words = words_of(t.as_py() if t.is_valid else b"")
                a = np.fromiter(map(ids.__getitem__, words), "<u2", len(words))
                rows.append(a.tobytes() + end)
                rest.append(b" ".join([words[i] for i in np.flatnonzero(a >= first).tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(rest, pa.binary()), *b.columns[1:]], ["ids", "rest", *b.schema.names[1:]])

    return number


def _runs(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """The numbers of some texts after each other, behind an end: every text begins from an end and runs into one."""
    held: list[bytes] = []
    size = 0
    for b in batches:
        for t in b.column(0).to_pylist():
            held.append(t)
            size += len(t) // 2
            if size >= AT_ONCE:
                yield np.frombuffer(b"".join([np.array([end], "<u2").tobytes(), *held]), "<u2").astype(np.int64)
                held, size = [], 0
    if held:
        yield np.frombuffer(b"".join([np.array([end], "<u2").tobytes(), *held]), "<u2").astype(np.int64)


#: Types of counts by their bytes.
_WIDTHS = {1: "<u1", 2: "<u2", 4: "<i4"}


def _dealt(table: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """``table``: sides x numbers x classes; ``block`` numbers a row, a byte a count where that is enough."""
    for k in range(0, table.shape[1], block):
        part = table[:, k : k + block]
        if most := part.max(initial=0):
            kind = next(x for x in _WIDTHS.values() if most <= np.iinfo(x).max)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], ["block", "counts"])


def _count_pairs(fold: np.ndarray, size: int):
    """Bigrams of ``fold[number]``, which is below ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int32)
        for a in _runs(batches, len(fold) - 1):
            a = fold[a]
            table += np.bincount(a[:-1] * size + a[1:], minlength=size * size).astype(np.int32)
        yield from _dealt(table.reshape(1, size, size), PAIR_BLOCK)

    return count


def _count_classes(own: np.ndarray, size: int):
    """For each number how often each class is after it and before it, BLOCK numbers a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, len(own) * size), np.int32)
        for a in _runs(batches, len(own) - 1):
            near = own[a]
            for side, cells in ((0, a[:-1] * size + near[1:]), (1, a[1:] * size + near[:-1])):
                table[side] += np.bincount(cells, minlength=len(own) * size).astype(np.int32)
        yield from _dealt(table.reshape(2, len(own), size), BLOCK)

    return count


def _add_blocks(words: int, size: int, sides: int, block: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw, cells = raw.as_buffer(), sides * size * min(block, words - k)
                part = np.frombuffer(raw, _WIDTHS[raw.size // cells])
                if k not in total:
                    total[k] = np.zeros(cells, np.int64)
                total[k] += part
        for k in list(total):  # a batch a block: all of them at once would be a large buffer in the JVM too
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.pop(k).astype("<i8").tobytes()], pa.binary())], ["block", "counts"])

    return add


def pair_counts(sequences: DataFrame, fold: np.ndarray, size: int) -> np.ndarray:
    """Bigrams of ``fold[number]`` over all sequences, ``size`` x ``size``."""
    blocks = sequences.select("ids").mapInArrow(_count_pairs(fold, size), "block int, counts binary").repartition("block").mapInArrow(_add_blocks(size, size, 1, PAIR_BLOCK), "block int, counts binary")
    pairs = np.zeros((size, size), np.int64)
    for r in blocks.collect():
        part = np.frombuffer(r["counts"], "<i8").reshape(-1, size)
        pairs[r["block"] : r["block"] + len(part)] = part
    return pairs


def context_parts(sequences: DataFrame, own: np.ndarray, size: int) -> DataFrame:
    """(block, counts): [after, before] x BLOCK numbers x classes, as each task counted them, dealt by block."""
    return sequences.select("ids").mapInArrow(_count_classes(own, size), "block int, counts binary").repartition("block")


def class_contexts(sequences: DataFrame, own: np.ndarray, size: int) -> DataFrame:
    """The sums of ``context_parts``, a bounded table, whatever the size of the corpus. The rounds need only what follows from
    the sums, and so add up where they choose classes."""
    return context_parts(sequences, own, size).mapInArrow(_add_blocks(len(own), size, 2, BLOCK), "block int, counts binary")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            after, before = np.frombuffer(raw, "<i8").reshape(2, -1, size)
            yield k, after, before


def class_transitions(contexts: DataFrame, own: np.ndarray, size: int) -> np.ndarray:
    """From ``class_contexts``, what ``pair_counts`` of the classes has from the sequences."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, size), np.int64)
        for k, after, _ in _blocks(batches, size):
            np.add.at(table, own[k : k + len(after)], after)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["table"])

    out = np.zeros((size, size))
    for r in contexts.mapInArrow(add, "table binary").collect():  # no more rows than blocks
        out += np.frombuffer(r["table"], np.int64).reshape(size, size)
    return out


def best_classes(contexts: DataFrame, gains: Gains, size: int, words: int, add: Callable = iter) -> np.ndarray:
    """The class that gains most for each of the first ``words`` numbers; ``add`` makes sums of a partition's ``contexts``, if
    they are none yet."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, after, before in _blocks(add(batches), size):
            target = (before @ gains.before + after @ gains.after).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([target.astype(np.uint8).tobytes()], pa.binary())], ["block", "classes"])

    out = np.zeros(words, np.int64)
    for r in contexts.mapInArrow(choose, "block int, classes binary").collect():  # a byte a word
        part = np.frombuffer(r["classes"], np.uint8)[: max(0, words - r["block"])]
        out[r["block"] : r["block"] + len(part)] = part
    return out


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words, or nearly as many: steps of counts that fit, then of the next step the words of the
    smallest hashes, as many as are left on average, so that ties at the border leave no one out."""
    short = counts.where(F.length("word") <= HEAD_BYTES)
    step = F.floor(F.log2("n") * 8)
    steps = sorted(((r["step"], r["n"]) for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    wanted, left, parts = F.lit(True), most, 1 << 20
    for s, n in steps:
        if n > left:
            wanted = (step > s) | ((step == s) & (F.pmod(F.xxhash64("word"), F.lit(parts)) < int(parts * left / n)))
            break
        left -= n
    rows = short.where(wanted).collect() if most else []
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))[:most]


# ---------------------------------------------------------------- exchange clustering, on the driver


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_classes(pairs: np.ndarray, words: int, classes: int = CLASSES) -> np.ndarray:
    """``pairs``: bigram counts, first the ``words`` to be clustered in order of frequency, then fixed ones, each a class
    of its own. Returns the class of each row; words take 0..classes-1."""
    n = len(pairs)
    own = np.concatenate([np.arange(words) % classes, np.arange(n - words) + classes])
    size = classes + n - words
    pairs = pairs.astype(np.float64)
    by_class = np.zeros((size, n))
    np.add.at(by_class, own, pairs)  # class -> word
    to_class = np.zeros((n, size))
    np.add.at(to_class.T, own, pairs.T)  # word -> class
    table = np.zeros((size, size))
    np.add.at(table, own, to_class)
    left, right = pairs.sum(axis=1), pairs.sum(axis=0)
    ends, starts = np.bincount(own, left, size), np.bincount(own, right, size)
    k = np.arange(classes)
    least = max(1e-9, 1e-12 * float(_xlogx(pairs.sum())))  # above the error of the sums, so that moves come to an end
    moved = 1
    while moved:
        moved = 0
        for w in range(words):
            r, l, s, c = to_class[w].copy(), by_class[:, w].copy(), pairs[w, w], own[w]
            # Take w out of its class; its bigram with itself is neither in r nor in l afterwards.
            r[c] -= s
            l[c] -= s
            table[c] -= r
            table[:, c] -= l
            table[c, c] -= s
            ends[c] -= left[w]
            starts[c] -= right[w]
            new_rows, new_cols = table[:classes] + r, table[:, :classes].T + l
            gain = (_xlogx(new_rows) - _xlogx(table[:classes])).sum(axis=1) + (_xlogx(new_cols) - _xlogx(table[:, :classes].T)).sum(axis=1)
            diagonal = table[k, k]
            gain += _xlogx(diagonal + r[k] + l[k] + s) + _xlogx(diagonal) - _xlogx(new_rows[k, k]) - _xlogx(new_cols[k, k])
            gain -= _xlogx(ends[:classes] + left[w]) - _xlogx(ends[:classes]) + _xlogx(starts[:classes] + right[w]) - _xlogx(starts[:classes])
            best = int(gain.argmax())
            if gain[best] <= gain[c] + least:
                best = int(c)
            table[best] += r
            table[:, best] += l
            table[best, best] += s
            ends[best] += left[w]
            starts[best] += right[w]
            if best != c:
                moved += 1
                own[w] = best
                by_class[c] -= pairs[w]
                by_class[best] += pairs[w]
                to_class[:, c] -= pairs[:, w]
                to_class[:, best] += pairs[:, w]
    return own


# ---------------------------------------------------------------- exchange in rounds


def log_likelihood(transitions: np.ndarray) -> float:
    """Of the class bigrams, up to what does not depend on the classes."""
    return float(_xlogx(transitions).sum() - _xlogx(transitions.sum(axis=0)).sum() - _xlogx(transitions.sum(axis=1)).sum())


def exchange_rounds(sequences: DataFrame, own: np.ndarray, words: int, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """``own``: the classes to begin with of the first ``words`` numbers, which may move to 0..classes-1, and of the rest, which
    stay. Returns the classes of the highest likelihood, their transitions, and the likelihood of each round."""
    size = int(own.max()) + 1
    best, seen = None, []
    for k in range(rounds + 1):
        transitions = pair_counts(sequences, own, size).astype(np.float64)
        seen.append(log_likelihood(transitions))
        if best is None or seen[-1] > seen[best[2]]:
            best = (own, transitions, k)
        if k == rounds or (k > 1 and max(seen[-2:]) < seen[-3] + GAIN * abs(seen[-3])):
            break
        target = best_classes(context_parts(sequences, own, size), Gains(transitions, classes), size, words, _add_blocks(len(own), size, 2, BLOCK))
        movable = (own[:words] >= classes) | (np.arange(words) % 2 == k % 2)
        own = own.copy()
        own[:words] = np.where(movable, target, own[:words])
    return best[0], best[1], seen


# ---------------------------------------------------------------- classes of all other words


class Gains:
    """What a word's bigrams add to the log-likelihood in each of the first ``classes`` classes, their tables as they are."""

    def __init__(self, transitions: np.ndarray, classes: int):
        t = transitions + 0.5
        out, into = np.log(t.sum(axis=1)), np.log(t.sum(axis=0))
        self.classes, self.single = classes, SINGLE
        self.before = np.log(t[:, :classes]) - into[None, :classes]  # by class before, own class
        self.after = np.log(t[:classes]).T - out[None, :classes]  # by class after, own class

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """``pairs``: class before and class after, a row each."""
        return self.before[pairs[:, 0]] + self.after[pairs[:, 1]]

    def add(self, word: np.ndarray, count: np.ndarray, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For the words that ``word`` numbers from 0 in order, a number a row: how often each class is before and after it,
        and the gains that workers passed on as sums."""
        words, size = int(word[-1]) + 1, len(self.before)
        few = count <= self.single
        pairs = np.frombuffer(b"".join(rows.filter(pa.array(few)).to_pylist()), np.uint8).reshape(-1, 2)
        at = np.repeat(word[few], count[few]) * size
        near = np.stack([np.bincount(at + pairs[:, k], minlength=words * size).reshape(words, size) for k in (0, 1)], axis=1)
        sums = np.zeros((words, self.classes))
        for k in np.flatnonzero(~few).tolist():
            sums[word[k]] += np.frombuffer(rows[k].as_py(), "<f8")
        return near, sums

    def best(self, near: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return (near[:, 0] @ self.before + near[:, 1] @ self.after + sums).argmax(axis=1)


def _count_contexts(own: np.ndarray, first: int, gains: Gains):
    """Words beyond the ``first`` numbers with the classes before and after them."""
    classes = own.astype(np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = defaultdict(bytearray), 0

        def out() -> pa.RecordBatch:
            n = [len(x) // 2 for x in held.values()]
            rows = [bytes(x) if k <= gains.single else gains.of(np.frombuffer(x, np.uint8).reshape(-1, 2)).sum(axis=0).astype("<f8").tobytes() for k, x in zip(n, held.values())]
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], ["word", "n", "bigrams"])

        for b in batches:
            for ids, rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.frombuffer(ids, "<u2")
                at = np.flatnonzero((a >= first) & (a < len(classes) - 1))
                words = rest.split(b" ") if len(at) else []
                row = np.concatenate([classes[-1:], classes[a]])
                near = np.stack([row[at], row[at + 2]], axis=1).tobytes()
                for k, w in enumerate(words):
                    held[w] += near[2 * k : 2 * k + 2]
                total += len(at)
                if len(held) > HELD_WORDS or total > HELD_BIGRAMS:
                    yield out()
                    held.clear()
                    total = 0
        if held:
            yield out()

    return count


def _choose_classes(gains: Gains, first: int):
    """word, n and class from rows of word, n and bigrams in order of the words."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last word, which may go on: word, n, near, sums

        def out(words: list[bytes], n: np.ndarray, near: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            best = gains.best(near, sums).tolist()
            of = [first + form_of(w) if k == 1 else c for w, k, c in zip(words, n.tolist(), best)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(of, pa.int32())], ["word", "n", "class"])

        for b in batches:
            if not b.num_rows:
                continue
            every, count = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            new = np.fromiter((x != y for x, y in zip(every, [None, *every])), bool, len(every))
            starts = np.flatnonzero(new)
            words, n = [every[k] for k in starts.tolist()], np.add.reduceat(count, starts)
            near, sums = gains.add(np.cumsum(new) - 1, count, b.column(2))
            if held is not None and held[0] == words[0]:
                n[0] += held[1]
                near[0] += held[2]
                sums[0] += held[3]
            elif held is not None:
                words, n = [held[0], *words], np.append(held[1], n)
                near, sums = np.concatenate([held[2][None], near]), np.concatenate([held[3][None], sums])
            if len(words) > 1:
                yield out(words[:-1], n[:-1], near[:-1], sums[:-1])
            held = words[-1], n[-1], near[-1].copy(), sums[-1].copy()
        if held is not None:
            yield out([held[0]], np.array([held[1]]), held[2][None], held[3][None])

    return choose


def all_classes(sequences: DataFrame, counts: DataFrame, head: int, own: np.ndarray, transitions: np.ndarray, classes: int) -> DataFrame:
    """word, n and class of the words beyond the ``head``."""
    if not classes:

        @F.arrow_udf("int")
        def form(words: pa.Array) -> pa.Array:
            return pa.array([form_of(w) for w in words.to_pylist()], pa.int32())

        return stage_table(counts.select("word", "n", form("word").alias("class")), "word-classes")
    gains = Gains(transitions, classes)
    rows = sequences.select("ids", "rest").mapInArrow(_count_contexts(own, head, gains), "word binary, n bigint, bigrams binary")
    # A word has one row of bounded size for each task (or HELD_WORDS words of a task) that read it; they are added up as
    # they come, so that no word's rows are ever a list.
    dealt = rows.repartition("word").sortWithinPartitions("word")
    return stage_table(dealt.mapInArrow(_choose_classes(gains, classes), "word binary, n bigint, class int"), "word-classes")


# ---------------------------------------------------------------- the model


class ClassModel:
    """What scoring needs of the counts: head words with class and count, class sizes and transitions."""

    def __init__(self, head: list[tuple[bytes, int]], own: np.ndarray, clustered: int, transitions: np.ndarray, distinct: np.ndarray, tokens: int, vocabulary: int, ends: int, sizes: np.ndarray | None = None):
        """``own``: classes of the ``clustered`` first head words, of the forms and of the end; ``distinct``: words by form;
        ``sizes``: words by class, where they are not only in forms."""
        self.tokens, self.vocabulary = tokens, vocabulary
        size = len(transitions)
        self.end = size - 1
        self.first_form = size - 1 - FORMS
        into = transitions.sum(axis=0)
        p = (into + 1) / (into.sum() + size)
        self.step = np.log10((transitions + BETA * p[None, :]) / (transitions.sum(axis=1, keepdims=True) + BETA))
        words = np.bincount(own[:clustered], minlength=size).astype(float)
        words[self.first_form : self.end] = distinct
        if sizes is not None:
            words = sizes.astype(float)
        words[self.end] = 1 if ends else 0
        self.class_log = np.log10(into + DELTA * (words + 1))  # denominators of emissions
        self.word_id = {w: i for i, (w, _) in enumerate(head)}
        count = np.array([n for _, n in head], np.float64)
        self.word_class = np.array([own[i] if i < clustered else self.first_form + form_of(w) for i, (w, _) in enumerate(head)], np.int64)
        # By number: head words, forms, the end.
        self.class_of = np.concatenate([self.word_class, self.first_form + np.arange(FORMS + 1)]).astype(np.uint8)
        self.number_base = np.concatenate([np.log10(count + 1), np.zeros(FORMS), [math.log10(ends + 1)]])
        self.number_emit = np.concatenate([np.log10(count + DELTA), np.zeros(FORMS), [math.log10(ends + DELTA)]])
        self.known = np.concatenate([np.ones(len(head), bool), np.zeros(FORMS, bool), [ends > 0]])
        self.base_log = math.log10(tokens + vocabulary + 1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "word_id"}  # tasks work with numbers

    def emissions(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of texts as numbers: tokens, known ones, base score, emissions and classes, as if no word beyond the head were known."""
        a = np.frombuffer(b"".join(ids), "<u2")
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        start = np.cumsum(n) - n
        known = np.add.reduceat(self.known[a].astype(np.int64), start)
        return n, known, np.add.reduceat(self.number_base[a], start) - n * self.base_log, np.add.reduceat(self.number_emit[a], start), binaries(self.class_of[a], np.append(start, len(a)))

    def paths(self, classes: list[bytes]) -> np.ndarray:
        """What the classes of each text add to its score: transitions, and the denominators of emissions."""
        if not classes:
            return np.zeros(0)
        a = bounded(classes, self.end)
        begin = np.cumsum([0, *map(len, classes[:-1])])
        return np.add.reduceat(self.step[a[:-1], a[1:]] - self.class_log[a[1:]], begin)


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """``values`` from each byte offset to the next."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def bounded(classes: list[bytes], end: int) -> np.ndarray:
    """The classes of some texts after each other, each with its end, behind an end."""
    return np.frombuffer(bytes([end]) + b"".join(classes), np.uint8).astype(np.int64)


def _count_steps(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for b in batches:
            a = bounded(b.column(0).to_pylist(), size - 1)
            table += np.bincount(a[:-1] * size + a[1:], minlength=size * size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], ["pair", "n"])

    return count


def _rare_words(head: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, word, at: each text's words beyond the head, once, and their places in the text, 4 bytes a place."""
        for b in batches:
            words, row, codes, places = [], [], [], []
            for nth, ids, rest in zip(*(b.column(k).to_pylist() for k in range(3))):
                if rest:
                    code: dict[bytes, int] = {}
                    first = len(words)
                    codes.append(np.array([first + code.setdefault(w, len(code)) for w in rest.split(b" ")], np.int64))
                    a = np.frombuffer(ids, "<u2")
                    places.append(np.flatnonzero((a >= head) & (a < head + FORMS)))
                    words += code
                    row += [nth] * len(code)
            if words:
                each = np.concatenate(codes)
                at = np.concatenate(places)[np.argsort(each, kind="stable")].astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(words, pa.binary()), binaries(at, np.append(0, 4 * np.cumsum(np.bincount(each))))], ["row", "word", "at"])

    return find


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n; ``texts`` has one binary column."""
    counts = texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stage_table(counts, "word-counts")


def learn(sequences: DataFrame, counts: DataFrame, head: list[tuple[bytes, int]]) -> tuple[Callable[..., ClassModel], DataFrame]:
    """The model of training texts as numbers, a function of its transitions, and the table of counts and classes of words
    beyond the head."""
    ends = sequences.count()
    sums = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    forms = np.array([form_of(w) for w, _ in head], np.int64)
    rest_of = np.arange(FORMS + 1)

    # Tier 1: words beyond the clustered ones stand in their forms.
    clustered = min(CLUSTERED, len(head))
    size = clustered + FORMS + 1
    fold_ = np.concatenate([np.arange(clustered), clustered + forms[clustered:], clustered + rest_of])
    classes = min(CLASSES, clustered)
    core = exchange_classes(pair_counts(sequences, fold_, size), clustered, classes) if clustered else np.arange(size)

    # Tiers 2 and 3.
    own = np.concatenate([core[:clustered], classes + forms[clustered:], classes + rest_of]).astype(np.int64)
    own, transitions, _ = exchange_rounds(sequences, own, len(head), classes, ROUNDS if classes else 0)
    rest = all_classes(sequences, counts, len(head), own, transitions, classes)
    sizes = np.bincount(own[: len(head)], minlength=len(transitions))
    for r in rest.groupBy("class").agg(F.count("*").alias("n")).collect():
        sizes[r["class"]] += r["n"]
    tokens, vocabulary = int(sums["n"] or 0) + ends, sums["v"] + (ends > 0)

    def model(steps: np.ndarray = transitions) -> ClassModel:
        return ClassModel(head, own, len(head), steps, np.zeros(FORMS), tokens, vocabulary, ends, sizes)

    return model, rest


def numbered(texts: DataFrame, head: list[tuple[bytes, int]], *others: str) -> DataFrame:
    """Texts, the first column, as numbers; ``others`` declares the other columns."""
    schema = ", ".join(["ids binary", "rest binary", *others])
    return stage_table(texts.mapInArrow(_number({w: i for i, (w, _) in enumerate(head)}), schema), "sequences")


def train(texts: DataFrame) -> tuple[Callable[..., ClassModel], DataFrame]:
    """``learn`` from ``texts``, which has one binary column."""
    counts = word_counts(texts)
    head = head_words(counts, HEAD)
    sequences = numbered(texts, head)
    out = learn(sequences, counts, head)
    drop_table(sequences)
    drop_table(counts)
    return out


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = F.coalesce(fold(key, FOLDS) == HELD_OUT, F.lit(False))
    words = word_counts(docs.where(~held).select(F.col(text).cast("binary").alias("text")))
    head = head_words(words, HEAD)
    texts = docs.select(F.col(text).cast("binary").alias("text"), F.col(key).alias("doc_id"), held.alias("held_out"), F.monotonically_increasing_id().alias("row"))
    sequences = numbered(texts, head, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}", "held_out boolean", "row bigint")
    trained, counts = learn(sequences.where(~F.col("held_out")), words, head)
    drop_table(words)
    model = trained()
    shared = spark.sparkContext.broadcast(model)  # a few numbers for each of HEAD words

    rare = sequences.select("row", "ids", "rest").mapInArrow(_rare_words(len(head)), "row bigint, word binary, at binary").join(counts, "word", "left")
    n, times = F.coalesce("n", F.lit(0)), (F.length("at") / 4).cast("bigint")
    known = F.col("class").isNotNull()
    added = rare.groupBy("row").agg(
        F.sum(F.when(n > 0, times).otherwise(0)).alias("more_known"),
        F.sum(times * F.log10(n + 1)).alias("more_base"),
        F.sum(times * F.log10(n + F.lit(DELTA))).alias("more_score"),
        F.collect_list(F.when(known, F.col("class"))).alias("found"),  # no more than the text's words
        F.collect_list(F.when(known, F.col("at"))).alias("places"),
    )

    @F.arrow_udf("struct<n:bigint,known:bigint,base:double,score:double,classes:binary>")
    def emit(ids: pa.Array) -> pa.Array:
        n, known, base, score, classes = shared.value.emissions(ids.to_pylist())
        return pa.StructArray.from_arrays([pa.array(n), pa.array(known), pa.array(base), pa.array(score), classes], ["n", "known", "base", "score", "classes"])

    @F.arrow_udf("binary")
    def fill(classes: pa.Array, found: pa.Array, places: pa.Array) -> pa.Array:
        """The classes of the words that were found, at their places, in all texts of a batch at once."""
        rows = classes.to_pylist()
        start = np.cumsum([0, *map(len, rows)])
        own = np.frombuffer(bytearray(b"".join(rows)), np.uint8)
        each, at = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), places.flatten().to_pylist()
        times = np.fromiter(map(len, at), np.int64, len(at)) // 4
        text = np.repeat(np.repeat(np.arange(len(rows)), each), times)
        own[start[text] + np.frombuffer(b"".join(at), "<i4")] = np.repeat(found.flatten().to_numpy(zero_copy_only=False), times)
        return binaries(own, start)

    out = sequences.select("row", "doc_id", "held_out", emit("ids").alias("r")).select("row", "doc_id", "held_out", "r.*")
    out = out.join(added, "row", "left").withColumn("classes", fill("classes", "found", "places")).drop("row", "found", "places")
    out = stage_table(out, "text-classes")
    drop_table(sequences)
    drop_table(counts)
    size = model.end + 1
    steps = np.zeros(size * size)
    for r in out.where(~F.col("held_out")).select("classes").mapInArrow(_count_steps(size), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most size * size rows
        steps[r["pair"]] = r["n"]
    final = trained(steps.reshape(size, size))
    final_shared = spark.sparkContext.broadcast(final)

    @F.arrow_udf("double")
    def path(classes: pa.Array) -> pa.Array:
        return pa.array(final_shared.value.paths(classes.to_pylist()), pa.float64())

    score = F.col("score") + F.coalesce("more_score", F.lit(0.0)) + path("classes")
    out = out.withColumn("score", score)
    score = F.col("score")
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n")).alias("perplexity"),
    )
