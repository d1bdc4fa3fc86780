"""Toxicity by a subsequence string kernel: Nyström landmarks, a linear support vector machine, the worst word decides.

The kernel of two words sums, over all subsequences of three letters that both have within ``SPAN`` characters,
``DECAY`` to the power of both spans; a gap or an inserted character only lengthens a span. A word's norm depends on
its length alone. The machine's function is a sum of kernels with the landmarks, so it is linear in the subsequence
weights of a word: scoring adds one weight per subsequence of the word, whatever the number of landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release_memory, slices

DECAY, SPAN, LONGEST = 0.6, 12, 24
_CODES, _START, _END, _GAP = 64, 27, 28, 63
_FITTED = 1 << 22  # numbers in the rows of subsequence weights that the fit holds at a time
_TIE = 0.002  # letters in a row only order words that the labels tell apart no better
_AT_ONCE = 3 << 20  # bytes of text scored together


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """Code of each code point in lower case: a to z, digits together, other letters, signs as gaps; two marks for borders."""
    out = (29 + (np.arange(0x110000) - 0xDF) % 34).astype(np.uint8)
    for c in range(0x250):
        if not chr(c).isalpha() or c < 128:
            out[c] = c - 97 if "a" <= chr(c) <= "z" else 26 if chr(c).isdigit() else _GAP
    out[1], out[2] = _START, _END
    return out


@lru_cache(64)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Places of all subsequences of three within the span, their weights, and the norm of a word of this length."""
    i, j, k = (a.ravel() for a in np.meshgrid(*[np.arange(length)] * 3, indexing="ij"))
    keep = (i < j) & (j < k) & (k - i < SPAN)
    i, j, k = i[keep], j[keep], k[keep]
    weight = DECAY ** (k - i + 1.0)
    return i, j, k, weight, float(np.sqrt((weight**2).sum())) or 1.0


def _starts(length: int) -> np.ndarray:
    """Places of the overlapping windows of a word that is longer than one."""
    return np.unique(np.append(np.arange(0, length - LONGEST, LONGEST // 2), length - LONGEST))


def pieces(word: str) -> list[str]:
    """The word with marks at both ends; a word longer than a window as its windows."""
    marked = f"\1{word}\2"
    return [marked] if len(marked) <= LONGEST else [marked[a : a + LONGEST] for a in _starts(len(marked)).tolist()]


def _windows(words: list[str], marked: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the words by length: (word numbers, codes); a longer word as overlapping windows.

    Words get marks at both ends; ``marked`` ones, pieces of words, are taken as they are.
    """
    given = words if marked else [f"\1{w}\2" for w in words]
    lengths = np.fromiter(map(len, given), np.int64, len(given))
    codes = _alphabet()[np.frombuffer("".join(given).encode("utf-32-le"), np.uint32)]
    first = np.cumsum(lengths) - lengths
    for n in np.unique(lengths[lengths <= LONGEST]).tolist():
        if n >= 5:
            own = np.flatnonzero(lengths == n)
            for at in range(0, len(own), 20_000 // n):
                part = own[at : at + 20_000 // n]
                yield part, codes[first[part][:, None] + np.arange(n)]
    for w in np.flatnonzero(lengths > LONGEST).tolist():
        starts = _starts(int(lengths[w]))
        for at in range(0, len(starts), 2048):
            part = starts[at : at + 2048]
            yield np.full(len(part), w), codes[first[w] + part[:, None] + np.arange(LONGEST)]


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each subsequence of three of each word (a row), and its weight, 0 if it holds a gap."""
    i, j, k, weight, norm = _triples(codes.shape[1])
    c = codes.astype(np.int32)
    sound = (c[:, i] != _GAP) & (c[:, j] != _GAP) & (c[:, k] != _GAP)
    return (c[:, i] * _CODES + c[:, j]) * _CODES + c[:, k], (sound * (weight / norm)).astype(np.float32)


def _mapped(words: list[str], column: np.ndarray, n_columns: int, marked: bool = False) -> np.ndarray:
    """Weights of the subsequences with a ``column`` (the kernel's feature map), a row for each word of one window."""
    out = np.zeros((len(words), n_columns), np.float32)
    for number, codes in _windows(words, marked):
        at, weight = _subsequences(codes)
        at = column[at]
        known = at >= 0
        np.add.at(out, (np.broadcast_to(number[:, None], at.shape)[known], at[known]), weight[known])
    return out


def _columns(words: list[str], marked: bool = False) -> tuple[np.ndarray, int]:
    """A column for each subsequence of the words; kernels with these words need no other."""
    used = [np.zeros(0, np.int32)]
    for _, codes in _windows(words, marked):
        at, weight = _subsequences(codes)
        used.append(at[weight > 0])
    used = np.unique(np.concatenate(used))
    column = np.full(_CODES**3, -1, np.int32)
    column[used] = np.arange(len(used))
    return column, len(used)


def word_values(words: list[str], table: np.ndarray, bias: float, marked: bool = False) -> np.ndarray:
    """Value of the function for each word: the sum of its subsequences' weights over its norm; the worst window counts."""
    out = np.full(len(words), -np.inf, np.float32)
    flat = table.ravel()
    for number, codes in _windows(words, marked):
        i, j, k, weight, norm = _triples(codes.shape[1])
        c = codes.astype(np.int32)
        value = flat[(c[:, i] * _CODES + c[:, j]) * _CODES + c[:, k]] @ (weight / norm).astype(np.float32)
        np.maximum.at(out, number, value)
    out[np.isinf(out)] = 0  # words under three characters are not judged
    return out + np.float32(bias)


def words_in(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch in lower case, the word of each place, and the first place of each text (and the end).

    Words are split at white space and freed of signs around them. A run of three or more single characters is one
    more word, so that a spelled-out word is seen as well.
    """
    split = pa.compute.utf8_split_whitespace(pa.compute.utf8_lower(texts.fill_null("")))
    trimmed = pa.compute.utf8_trim(split.values, characters=" .,;:!?\"'()[]{}*%&$#|")
    coded = trimmed.dictionary_encode()
    words = coded.dictionary.to_pylist()
    place, first = np.asarray(coded.indices).astype(np.int64), np.asarray(split.offsets).astype(np.int64)
    single = np.fromiter((len(w) == 1 for w in words), bool, len(words))[place] if len(place) else np.zeros(0, bool)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    edge = np.concatenate([[True], (single[1:] != single[:-1]) | (text[1:] != text[:-1]), [True]]) if len(place) else np.array([True])
    runs = np.flatnonzero(edge)
    add = [(int(text[a]), "".join(words[w] for w in place[a:b])) for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()) if b - a > 2 and single[a]]
    if add:
        new_text = np.concatenate([text, [t for t, _ in add]]).astype(np.int64)
        place = np.concatenate([place, len(words) + np.arange(len(add))])
        words += [w for _, w in add]
        order = np.argsort(new_text, kind="stable")
        place, first = place[order], np.searchsorted(new_text[order], np.arange(len(texts) + 1))
    return words, place, first


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # weight of each subsequence
    bias: float
    slope: float
    offset: float

    def chance(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst.astype(np.float64) + self.offset, -500, 500)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the active rows."""
    width = x.shape[1] + 1
    w, ridge = np.zeros(width), np.eye(width)
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        left, right = ridge.copy(), np.zeros(width)
        for at in range(0, len(x), 1024):  # few rows at a time in double precision
            part, sign, c = np.ones((len(x[at : at + 1024]), width)), y[at : at + 1024], cost * weight[at : at + 1024]
            part[:, :-1] = x[at : at + 1024]
            active = sign * (part @ w) < 1
            scaled = part[active] * c[active, None]
            left += scaled.T @ part[active]
            right += scaled.T @ sign[active]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _sigmoid(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through labelled values, by Newton steps with a little prior weight."""
    x = np.stack([value, np.ones(len(value))], axis=1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (label - p) - 1e-2 * (w - np.array([1.0, 0.0]))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _inserted(piece: str, rng: np.random.Generator) -> list[str]:
    """The piece of a word spelled with signs between its letters, and with one sign or letter inserted, if that fits a window."""
    word = piece.strip("\1\2")
    at = int(rng.integers(1, max(len(word), 2)))
    forms = [".".join(word), word[:at] + chr(97 + int(rng.integers(26))) + word[at:], word[:at] + "-" + word[at:]]
    start, end = "\1" * piece.startswith("\1"), "\2" * piece.endswith("\2")
    return [start + f + end for f in forms if len(start + f + end) <= LONGEST]


def _telling(names: list[str], held: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each piece the strongest sign of toxic texts among its runs of three letters: log odds by the root of their number."""
    out = np.zeros(len(names))
    of, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number, codes in _windows(names, True):
        c = codes.astype(np.int64)
        sound = ((c[:, :-2] != _GAP) & (c[:, 1:-1] != _GAP) & (c[:, 2:] != _GAP)).ravel()
        of.append(np.repeat(number, c.shape[1] - 2)[sound])
        runs.append(((c[:, :-2] * _CODES + c[:, 1:-1]) * _CODES + c[:, 2:]).ravel()[sound])
    of, runs = np.concatenate(of), np.concatenate(runs)
    order = np.argsort(of, kind="stable")
    of, runs = of[order], runs[order]
    first = np.searchsorted(of, np.arange(len(names) + 1))
    counts = np.zeros((2, _CODES**3))
    for own, y in zip(held, labels):
        if len(own):
            counts[int(y), np.unique(np.concatenate([runs[first[w] : first[w + 1]] for w in own.tolist()]))] += 1
    clean, toxic = counts
    odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / ((1 - labels).sum() + 1))
    np.maximum.at(out, of, (odds * np.sqrt(toxic))[runs])
    return out


def fit(
    bags: list[list[str]], labels: np.ndarray, n_landmarks: int = 480, rounds: int = 3,
    n_usual: int = 4000, n_random: int = 6000, n_worst: int = 2000, n_changed: int = 400,
) -> Model:
    """Machine from labelled bags of words: in a toxic text the worst words are witnesses, in a clean one every word counts.

    Words longer than a window count as their windows, from the first to the last. The machine takes every witness,
    changed spellings of ``n_changed`` of them, and as clean words the ``n_usual`` that most clean texts hold,
    ``n_random`` drawn ones and, after each round, the ``n_worst`` of all that the round took for the worst.
    """
    rng = np.random.default_rng(0)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(_CODES**3, np.float32), 0.0, 0.0, 500.0 if share == 1 else -500.0)
    bags = [sorted({p for w in b for p in pieces(w)}) for b in bags]
    names = sorted({p for b in bags for p in b})
    number = {w: i for i, w in enumerate(names)}
    held = [np.array([number[w] for w in b], np.int64) for b in bags]
    toxic, clean = np.zeros(len(names)), np.zeros(len(names))
    for own, y in zip(held, labels):
        (toxic if y else clean)[own] += 1
    n_toxic, n_clean = labels.sum(), (1 - labels).sum()
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    size = np.fromiter((len(n.strip("\1\2")) for n in names), np.int64, len(names))
    # first guess of the witnesses: words that toxic texts hold, or else those with letters in a row that they hold
    known, telling = odds * np.sqrt(toxic), _telling(names, held, labels)
    value = np.where(size >= 3, known + _TIE * telling, -np.inf)
    ranked = [np.argsort(-np.where(size >= 3, v, -np.inf), kind="stable") for v in (known, telling)]
    bad = np.unique(np.concatenate([ranked[0][: n_landmarks // 2], ranked[1][: n_landmarks // 4]]))
    respelled = np.argsort(-value, kind="stable")[:16]
    usual = np.argsort(-np.where(size >= 3, clean, -1), kind="stable")[: n_landmarks // 4]
    other = rng.choice(len(names), min(n_landmarks // 4, len(names)), replace=False)
    landmarks = sorted({names[i] for i in (*bad, *usual, *other)} | {v for i in respelled for v in _inserted(names[i], rng)[:2]})
    column, width = _columns(landmarks, True)
    mapped = _mapped(landmarks, column, width, True)
    root, turn = np.linalg.eigh((mapped @ mapped.T).astype(np.float64))
    keep = root > 1e-6 * root.max()
    whiten = turn[:, keep] / np.sqrt(root[keep])  # Nyström: kernels with the landmarks to coordinates
    base = mapped.T @ whiten.astype(np.float32)  # weights of each coordinate
    del mapped
    in_clean = np.flatnonzero((clean > 0) & (size >= 3))
    often = in_clean[np.argsort(-clean[in_clean], kind="stable")[:n_usual]]
    negative = np.unique(np.concatenate([often, rng.choice(in_clean, min(n_random, len(in_clean)), replace=False)])) if len(in_clean) else in_clean
    table, bias = np.zeros(_CODES**3, np.float32), 0.0
    at_once = max(_FITTED // width, 1)
    for step in range(rounds):
        witness: dict[int, int] = {}
        for own, y in zip(held, labels):
            if y and len(own):
                top = value[own].max()
                # other words that look as bad are witnesses as well: a text may hold several insults
                for w in own[value[own] >= (min(top, 1.0) if step else top / 2 if top > 0 else top)].tolist():
                    if np.isfinite(value[w]) and (step or odds[w] > 1):
                        witness[w] = witness.get(w, 0) + 1
        sure = [w for w in witness if toxic[w] * n_clean > 3 * clean[w] * n_toxic] or list(witness)
        if not sure:
            break
        positive = [names[w] for w in sure]
        often_seen = np.array([witness[w] for w in sure], np.float64)
        changed = [(v, n / 2) for p, n in zip(positive[:n_changed], often_seen) for v in _inserted(p, rng)]
        words = [*positive, *(v for v, _ in changed), *(names[i] for i in negative)]
        x = np.empty((len(words), base.shape[1]), np.float32)
        for a in range(0, len(words), at_once):
            x[a : a + at_once] = _mapped(words[a : a + at_once], column, width, True) @ base
        y = np.concatenate([np.ones(len(positive) + len(changed)), -np.ones(len(negative))])
        weight = np.concatenate([often_seen, [n for _, n in changed], np.ones(len(negative))])
        weight[y > 0] *= max(len(negative), 1) / (4 * weight[y > 0].sum())
        w, bias = _machine(x, y, weight)
        table = np.zeros(_CODES**3, np.float32)
        table[column >= 0] = base @ w.astype(np.float32)
        value = np.where(size >= 3, word_values(names, table, bias, True), -np.inf)
        worst = in_clean[np.argsort(-value[in_clean], kind="stable")[:n_worst]]  # clean words that look worst
        negative = np.unique(np.concatenate([negative, worst]))
    worst = np.array([value[own].max() if len(own) and np.isfinite(value[own].max()) else bias for own in held])
    slope, offset = _sigmoid(worst, labels.astype(np.float64))
    return Model(table, bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 2000, max_clean: int = 3000, max_bytes: int = 1 << 16) -> Model:
    """Model from labelled documents: ``labels`` has ``id_col`` and ``label_col`` (1 toxic, 0 clean, else ignored).

    The fit takes at most ``max_toxic`` and ``max_clean`` labelled documents of at most ``max_bytes`` each, those with
    the least hash of the id: this sample is all that reaches the driver, as distinct words. A document with
    several labels is toxic if one of them is. With labels of one class or none the score is constant.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = known.filter("id is not null").withColumn("o", F.xxhash64("id"))
    picked = known.filter("y = 1").orderBy("o", "id").limit(max_toxic).unionByName(known.filter("y = 0").orderBy("o", "id").limit(max_clean))
    picked = spark.createDataFrame(picked.select("id", "y").toArrow())  # max_toxic + max_clean rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= max_bytes)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, place, first = words_in(batch.column(1))
            own = [[words[w] for w in np.unique(place[a:b])] for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.string()))], names=["id", "y", "words"])
            release_memory()

    found = texts.join(F.broadcast(picked), "id").select("id", "text", "y").mapInArrow(bag, "id long, y int, words array<string>").toArrow()
    found = found.sort_by("id")
    return fit(found.column("words").to_pylist(), np.array(found.column("y").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the chance that the text is toxic: that of its worst word.

    Every word of the whole text counts; a null or empty text has the score of a word without subsequences. All
    columns and rows are kept; a column ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    renamed = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)))
    at = kept.index(text_col)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for a, b in slices(batch.column(at), _AT_ONCE):
                part = batch.slice(a, b - a)
                words, place, first = words_in(part.column(at))
                worst = np.full(part.num_rows, model.bias, np.float32)
                if len(place):
                    value = word_values(words, model.table, model.bias)[place]
                    some = np.flatnonzero(np.diff(first))
                    worst[some] = np.maximum.reduceat(value, first[some])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.chance(worst))], names=[*part.schema.names, "score"])
                release_memory()

    fields = [f"c{i} {renamed.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept))]
    scored = renamed.mapInArrow(work, ", ".join([*fields, "score double"]))
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("score").alias(out))
