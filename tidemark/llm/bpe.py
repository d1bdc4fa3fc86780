"""Byte-level BPE through a table of distinct words: encode each word once, join ids back by position."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import dump, load, packed, release_memory, slices, unpacked

_BLOCK = 32 << 20
_KNOWN = 150_000  # words whose ids a worker remembers
_KNOWN_U2 = 200_000  # the same, for ids kept as bytes
_SHORT = 64  # characters of a word that is remembered as bytes, so that the table is bounded in bytes
_AT_ONCE = 6 << 20  # bytes of text whose units are held together
#: The split of byte-level BPE files of this kind, before the merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"  # letters in every version of Unicode in use


def read_vocabulary(spark: SparkSession, path: str) -> str:
    """Text of a tokenizer file, read on the driver; its size is that of one vocabulary, checked here."""
    with open(path, encoding="utf-8") as f:
        spec = f.read(64 << 20)
    held = json.loads(spec)  # fails if it was cut
    if held["model"]["type"] != "BPE" or held["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or held.get("normalizer"):
        raise ValueError("not a byte-level BPE file with the standard split and no normalizer")
    return spec


def strings(values: pa.Array) -> list[str]:
    """``values.to_pylist()`` without a scalar object for each value."""
    return values.to_numpy(zero_copy_only=False).tolist()


def units_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of a block of texts, the unit of each place, and the first place of each text (and the end).

    A unit is what lies between two single blanks, with the blank before it; these are always borders of words. A
    text with any other white space beside a blank or at its ends is one unit, as is a null or empty text.
    """
    split = pa.compute.split_pattern(texts.fill_null(""), " ")
    coded = split.values.dictionary_encode()
    pieces = strings(coded.dictionary)
    place = np.asarray(coded.indices).astype(np.int64)
    first = np.asarray(split.offsets).astype(np.int64)
    if not len(texts):
        return [], place, first
    odd = np.fromiter((not p or p[0].isspace() or p[-1].isspace() for p in pieces), bool, len(pieces))
    whole = np.flatnonzero(np.logical_or.reduceat(odd[place], first[:-1]))
    units = [" " + p for p in pieces]
    starts, at = np.unique(place[first[:-1]], return_inverse=True)  # the first unit of a text has no blank
    place[first[:-1]] = len(units) + at
    units += [pieces[i] for i in starts]
    if len(whole):
        count = np.diff(first)
        is_whole = np.zeros(len(texts), bool)
        is_whole[whole] = True
        kept = place[np.repeat(~is_whole, count)]
        count[whole] = 1
        first = np.concatenate([[0], np.cumsum(count)])
        place = np.empty(first[-1], np.int64)
        place[np.repeat(~is_whole, count)] = kept
        place[first[whole]] = len(units) + np.arange(len(whole))
        units += [texts[int(i)].as_py() or "" for i in whole]
    return units, place, first


class Words:
    """Split of units into words as the tokenizers library splits texts, and their encoding by that library's model.

    The string of an added token in a text is one word of its own.
    """

    def __init__(self, spec: str):
        held = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        added = held["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or regex.search(r"\s", a["content"]) for a in added):
            raise ValueError("added tokens that change their surroundings or hold blanks are not supported")
        self.added = {a["content"]: a["id"] for a in added}
        self.cut = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.words = regex.compile(_SPLIT).findall
        self.plain = not any(regex.fullmatch(r"[\p{L}.,;:!?]+", a) for a in self.added)
        self.known: dict[str, list[int]] = {}
        self.known_u2: dict[str, bytes] = {}
        self.met = bytearray(1 << 22)
        self.symbol = {b: c for c, b in byte_symbols().items()}

    def split(self, unit: str) -> list[str]:
        if self.cut is None or not any(a in unit for a in self.added):
            return self.words(unit)
        out = []
        for i, piece in enumerate(self.cut.split(unit)):
            out += [piece] if i % 2 else self.words(piece)
        return out

    def distinct(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words of the units; the words of all units by their numbers; the end of each unit there."""
        held = pa.array(units, pa.string())
        kind = np.zeros(len(units), np.int64)
        if self.plain:  # the two common kinds, letters and letters with a stop, need no pattern of the library
            kind = np.asarray(pa.compute.match_substring_regex(held, f"^ ?[{_LETTERS}]+$")).astype(np.int64)
            kind += 2 * np.asarray(pa.compute.match_substring_regex(held, f"^ ?[{_LETTERS}]+[.,;:!?]$"))
        stopped = held.filter(pa.array(kind == 2))
        rest = [self.split(units[i]) for i in np.flatnonzero(kind == 0).tolist()]
        count = kind.copy()
        count[kind == 0] = list(map(len, rest))
        first = np.cumsum(count) - count
        parts = [held.filter(pa.array(kind == 1)), pa.compute.utf8_slice_codeunits(stopped, 0, -1), pa.compute.utf8_slice_codeunits(stopped, -1), pa.array(list(chain.from_iterable(rest)), pa.string())]
        coded = pa.concat_arrays([p.cast(pa.string()) for p in parts]).dictionary_encode()
        number = np.asarray(coded.indices).astype(np.int64)
        at = np.cumsum([len(p) for p in parts])
        word = np.empty(int(count.sum()), np.int64)
        word[first[kind == 1]] = number[: at[0]]
        word[first[kind == 2]] = number[at[0] : at[1]]
        word[first[kind == 2] + 1] = number[at[1] : at[2]]
        word[np.repeat(kind == 0, count)] = number[at[2] :]
        return strings(coded.dictionary), word, first + count

    def encode(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            if word in self.added:
                return [self.added[word]]
            got = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.symbol))]
            if len(self.known) < _KNOWN:  # kept when met again, so that rare words take no place
                at = hash(word) % len(self.met)
                if self.met[at]:
                    self.known[word] = got
                self.met[at] = 1
        return got

    def encode_u2(self, word: str) -> bytes:
        """Ids as little-endian 16-bit numbers: a word remembered so takes a third of a list's memory."""
        got = self.known_u2.get(word)
        if got is None:
            if word in self.added:
                return np.array([self.added[word]], "<u2").tobytes()
            got = b"".join([t.id.to_bytes(2, "little") for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.symbol))])
            if len(self.known_u2) < _KNOWN_U2 and len(word) <= _SHORT:
                at = hash(word) % len(self.met)
                if self.met[at]:
                    self.known_u2[word] = got
                self.met[at] = 1
        return got

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id-to-piece table of the library's byte-level decoder: all bytes, first byte and length by id."""
        table = byte_symbols()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for piece, number in vocabulary.items():
            # a piece with a symbol outside the byte alphabet (an added token) stands for its own text
            out[number] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
        length = np.array([len(p) for p in out], np.int64)
        return np.frombuffer(b"".join(out), np.uint8), np.cumsum(length) - length, length


@lru_cache(1)
def words_of(spec: str) -> Words:
    """One per Python worker."""
    return Words(spec)


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: itself, or the next free from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _sent(rows) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
_TYPE = "bucket int, block long, body binary"


def _dealt(words: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words by bucket and in sorted order there, and their buckets."""
    bucket = np.fromiter((crc32(w.encode()) % n_buckets for w in words), np.int64, len(words))
    order = np.asarray(pa.compute.sort_indices(pa.array(words, pa.string()))).astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    return order, bucket[order]


def encode_decode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of each whole text, and the text that the ids decode to.

    Returns one row per input row: ``id_col``, the columns of ``keep``, ids array<int>, decoded string. ids equal
    those of the tokenizers library for ``spec`` (the text of its file) without special tokens added; a null
    text is empty, and an empty text has no ids and decodes to ''. Repeated rows and null ids pass through.

    Texts are cut into blocks and split into words there. Each block sends its distinct words, front to back in
    sorted order, to buckets by word; a bucket encodes each distinct word once, whatever the number of blocks
    and occurrences, and answers each block in the order it was asked. The block joins ids back by position.
    Decoding joins the ids with the table of pieces, which has one row per vocabulary entry.
    """
    blocks = packed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))), "text", _BLOCK, level=9)
    n_buckets = max(blocks.count(), 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(spec)
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own = list(_words_of_block(_text(unpacked(body)), words)[0])
                order, bucket = _dealt(own, n_buckets)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for at, part in zip([0, *cuts], np.split(order, cuts) if len(order) else ()):
                    yield from _sent([(int(bucket[at]), number, _message([own[i] for i in part.tolist()]))]).to_batches()
        release_memory()

    def answer(sent: pa.Table) -> pa.Table:
        words = words_of(spec)
        asked = [_asked(b) for b in sent.column("body").to_pylist()]
        distinct = sorted(set().union(*asked))
        ids = {w: words.encode(w) for w in distinct}
        out = []
        for block, bucket, own in zip(sent.column("block").to_pylist(), sent.column("bucket").to_pylist(), asked):
            lengths = np.fromiter((len(ids[w]) for w in own), np.int64, len(own))
            flat = np.fromiter((i for w in own for i in ids[w]), np.int64, int(lengths.sum()))
            out.append((bucket, block, dump(_least(lengths), _least(flat))))
        ids.clear()
        release_memory()
        return _sent(out)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        words = words_of(spec)
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("body").to_pylist()))
        piece_bytes, piece_first, piece_length = words.pieces()
        out = []
        for body in left.column("body").to_pylist():
            rows = unpacked(body)
            seen, parts = _words_of_block(_text(rows), words)
            numbers, bucket = _dealt(list(seen), n_buckets)
            lengths, firsts, flat, at = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int64), [], 0
            for b, reply in replies.items():
                own, ids = load(reply)
                own = own.astype(np.int64)
                slot = numbers[np.searchsorted(bucket, b) : np.searchsorted(bucket, b, "right")]
                lengths[slot], firsts[slot] = own, at + np.cumsum(own) - own
                flat.append(ids.astype(np.int32))
                at += len(ids)
            flat = np.concatenate([*flat, np.zeros(0, np.int32)])
            for a, b, place, first, word, unit_words in parts:
                # ids and bytes of the distinct units, joined by position; then those of the texts, likewise
                unit_ids, ends = gathered(flat, firsts[word], lengths[word])
                n_ids = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], unit_words])])
                spelled, ends = gathered(piece_bytes, piece_first[unit_ids], piece_length[unit_ids])
                n_bytes = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_ids)])])
                for at in range(a, b, 256):  # bounds the memory
                    to = min(at + 256, b)
                    out += _joined(rows.slice(at, to - at), place, first[at - a : to - a + 1], (unit_ids, n_ids), (spelled, n_bytes))
                release_memory()
        release_memory()
        return pa.Table.from_batches(out)

    kept = "".join(f", k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    sent = blocks.mapInArrow(ask, _TYPE)
    replies = sent.groupBy("bucket").applyInArrow(answer, _TYPE)
    out = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(join, f"id {docs.schema[id_col].dataType.simpleString()}{kept}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "ids", "decoded")


def _message(words: list[str]) -> bytes:
    return dump(_least(np.array([len(w) for w in words])), "".join(words))


def _asked(body: bytes) -> list[str]:
    lengths, joined = load(body)
    end = np.cumsum(lengths.astype(np.int64))
    return [joined[a:b] for a, b in zip((end - lengths).tolist(), end.tolist())]


def _words_of_block(texts: pa.Array, words: Words) -> tuple[dict[str, int], list[tuple]]:
    """Distinct words of a block, numbered as met, and for each slice of it: rows, unit of each place, first places,
    words of the distinct units, end of each unit there. Strings of units are held for a slice at a time."""
    seen: dict[str, int] = {}
    parts = []
    for a, b in slices(texts, _AT_ONCE):
        units, place, first = units_of(texts.slice(a, b - a))
        own, word, unit_words = words.distinct(units)
        number = np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int32, len(own))
        parts.append((a, b, place.astype(np.int32), first, number[word], unit_words))
        del units, own
        release_memory()
    return seen, parts


def _text(rows: pa.Table) -> pa.Array:
    return pa.concat_arrays([*rows.column("text").chunks, pa.array([], pa.string())])


def _least(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


def gathered(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` side by side, and the end of each run there."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return values[np.arange(total) + np.repeat(first - (end - length), length)], end


def of_texts(place: np.ndarray, first: np.ndarray, runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values of some texts (their units' runs side by side), and the border of each text there."""
    values, length = runs
    unit = place[first[0] : first[-1]]
    out, end = gathered(values, (np.cumsum(length) - length)[unit], length[unit])
    return out, np.concatenate([[0], end])[first - first[0]]


def _joined(rows: pa.Table, place, first, ids, spelled) -> list[pa.RecordBatch]:
    ids, border = of_texts(place, first, ids)
    lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids))
    raw, border = of_texts(place, first, spelled)
    raw = raw.tobytes()
    decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(border[:-1].tolist(), border[1:].tolist())]
    keep = [rows.column(i).combine_chunks() for i, name in enumerate(rows.column_names) if name.startswith("k")]
    names = ["id", *(c for c in rows.column_names if c.startswith("k")), "ids", "decoded"]
    return pa.Table.from_arrays([rows.column("id").combine_chunks(), *keep, lists, pa.array(decoded, pa.string())], names=names).to_batches()
