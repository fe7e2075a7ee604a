"""Operator 8: exact BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding. A trie with suffix links (an Aho-Corasick automaton)
lists the vocabulary's tokens that end at each position, longest first; the first whose pair with the last token of the
prefix before it survives the merges is stored, and the ids are read back over these pointers. No merge loop runs.

The tokenizer file names the normaliser, the word splitter and the added tokens; these steps are the library's own.
Texts are first cut at ASCII white space, which the splitter drops and at which nothing joins, so that each distinct
piece is encoded once in a batch and once in a worker while the bounded memory of pieces holds it.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows give repeated rows; columns
besides the id and the text are not looked at. White space in a text is not kept by this vocabulary, so decoding gives
the library's form of the ids, not the source text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, pieces, ragged, slices

#: Entries that a worker keeps in each of its three memories (pieces, words, pairs), about 45 MB each; a full one is emptied.
MEMORY = 1 << 18
#: Bytes of text that are split and encoded at a time.
SLICE = 1 << 20


class Memory:
    """The ids of distinct texts: each text's place, and all ids one after the other in one array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def add(self, texts: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        """New texts, with the number of ids of each and their ids in a row."""
        n, m = len(self.place), len(texts)
        last = int(self.ends[n])
        self.ends, self.ids = self._room(self.ends, n + m + 1), self._room(self.ids, last + len(ids))
        self.ends[n + 1 : n + m + 1] = last + np.cumsum(counts)
        self.ids[last : last + len(ids)] = ids
        self.place.update(zip(texts, range(n, n + m), strict=True))

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of the texts at these places."""
        starts = self.ends[places]
        counts = self.ends[places + 1] - starts
        return counts, self.ids[ragged(starts, counts)]


class Bpe:
    """The tokenizer of a ``tokenizers`` JSON file whose model is BPE without unknown tokens, dropout or byte fallback."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("a plain BPE model is needed")
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("decoders and post-processors of tokenizer files are not supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # A word is spelt in symbols: its characters, of which the last carries the end mark. A marked symbol is moved
        # out of Unicode's first plane so that it stays one character and only matches at the end of a word.
        spell = self._spell
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair[x, y] = (r, z)
            if z not in self.halves:
                self.halves[z], self.rank[z] = (x, y), r
        self.automaton = ahocorasick.Automaton()
        self.symbols = set()
        for t, i in vocab.items():
            s = spell(t)
            if i in self.halves:
                self.automaton.add_word(s, (i, len(s)))
            elif len(s) == 1:
                self.symbols.add(s)
                self.automaton.add_word(s, (i, 1))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words, self.pieces = Memory(), Memory()
        top = max(self.names, default=-1) + 1
        self.numerals = pa.array([b"%d " % i for i in range(top)], pa.large_binary())
        self.tokens = pa.array([(self.names.get(i, "") + " ").encode() for i in range(top)], pa.large_binary())

    def _spell(self, token: str) -> str:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + 0x10000)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when their joined text is encoded: no merge across the seam comes before
        the merges that make the two sides. The later-made side is undone first, as the merges ran in that order."""
        limit = len(self.pair) + 1
        pair, halves, rank = self.pair, self.halves, self.rank
        ra, rb = rank.get(a, -1), rank.get(b, -1)
        while True:
            across = pair.get((a, b))
            if across is not None and across[0] < limit:
                return False
            if ra < 0 and rb < 0:
                return True
            # Of two equal merges the left one ran first, so the right one is undone first.
            if ra > rb:
                limit, a = ra, halves[a][1]
                ra = rank.get(a, -1)
            else:
                limit, b = rb + 1, halves[b][0]
                rb = rank.get(b, -1)

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one word as the splitter gives it."""
        if not word:
            return ()
        s = word[:-1] + chr(ord(word[-1]) + 0x10000) if self.end else word
        if not self.symbols.issuperset(s):  # the library leaves out what is no symbol of the model
            s = "".join(x for x in s if x in self.symbols)
            if not s:
                return ()
        fits = self.fits
        if len(fits) > MEMORY:
            fits.clear()
        last, lengths = [-1] * len(s), [0] * len(s)
        for at, (token, n) in self.automaton.iter(s):  # of those that end at one place, the longest comes first
            if not lengths[at]:
                if n <= at:
                    pair = (last[at - n], token)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self.compatible(*pair)
                    if not ok:
                        continue
                last[at] = token
                lengths[at] = n
        out, at = [], len(s) - 1
        if min(lengths) < 1:
            raise ValueError(f"no token ends some prefix of {word[:50]!r}: the merges don't make this vocabulary")
        while at >= 0:
            out.append(last[at])
            at -= lengths[at]
        return tuple(reversed(out))

    def piece(self, text: str) -> list[int]:
        """The ids of a text without ASCII white space, or of any text."""
        out: list[int] = []
        for part in self.special.split(text) if self.special and "<" in text else (text,):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                if self.normalizer is not None:
                    part = self.normalizer.normalize_str(part)
                out += self.all_words([x[0] for x in self.splitter.pre_tokenize_str(part)] if self.splitter is not None else [part])[1].tolist()
        return out

    def all_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of words as the splitter gives them."""
        known = self.words
        if len(known.place) > MEMORY:
            known.clear()
        new = list(dict.fromkeys(x for x in words if x not in known.place))
        if new:
            found = [self.word(x) for x in new]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            known.add(new, counts, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())))
        return known.of(np.fromiter(map(known.place.__getitem__, words), np.int64, len(words)))

    def all_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of many texts without ASCII white space. Normaliser and splitter run once over all that are joined
        by spaces, if the spaces alone tell them apart afterwards; the rest goes one by one."""
        plain = [i for i, x in enumerate(texts) if x and not (self.special and "<|" in x)]
        joined = " ".join([texts[i] for i in plain])
        if self.normalizer is not None:
            joined = self.normalizer.normalize_str(joined)
        parts = joined.split(" ")
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        if len(parts) == len(plain) and self.splitter is not None and len(plain) > 1:
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
            split = self.splitter.pre_tokenize_str(joined)
            at = np.searchsorted(ends, np.fromiter((x[1][0] for x in split), np.int64, len(split)), "right")
            counts, ids = self.all_words([x[0] for x in split])
            found.append((plain, np.bincount(at, counts, len(plain)).astype(np.int64), ids))
        elif len(plain) > 64:  # some text holds other white space: halves without it go the quick way
            half = len(plain) // 2
            found += [(some, *self.all_pieces([texts[i] for i in some])) for some in (plain[:half], plain[half:])]
        done = {i for some, _, _ in found for i in some}
        if len(done) == len(texts) and len(found) == 1:
            return found[0][1:]
        for i, x in enumerate(texts):
            if x and i not in done:
                ids = np.array(self.piece(x), np.int32)
                found.append(([i], np.array([len(ids)]), ids))
        counts = np.zeros(len(texts), np.int64)
        for some, n, _ in found:
            counts[some] = n
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int32)
        for some, n, ids in found:
            out[ragged(starts[some], n)] = ids
        return counts, out

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of whole texts."""
        offsets, index, distinct = pieces(column)
        known = self.pieces
        if len(known.place) > MEMORY:
            known.clear()
        new = [x for x in distinct if x not in known.place]
        if new:
            known.add(new, *self.all_pieces(new))
        counts, ids = known.of(np.fromiter(map(known.place.__getitem__, distinct), np.int64, len(distinct))[index])
        return np.concatenate([[0], np.cumsum(counts)])[offsets], ids

    def digests(self, table: pa.Array, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """SHA-256 of each row's entries of ``table``, without the last one's space."""
        texts = table.take(pa.array(ids))  # lie one after the other: joined
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][offsets]
        data = memoryview(texts.buffers()[2] or b"")
        return [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens' own strings, joined by a space; ids without a token are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def loaded(path: str) -> Bpe:
    mine = kept("bpe")
    if path not in mine:
        mine[path] = Bpe(path)
    return mine[path]


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text", SLICE, "bpe"):
            offsets, ids = bpe.rows(batch.column("text"))
            digests = [bpe.digests(table, offsets, ids) for table in (bpe.numerals, bpe.tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests[0]), pa.array(digests[1])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (array<int>), decoded_sha256 for every row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in slices(batches, "text", SLICE, "bpe"):
            bounds, ids = bpe.rows(batch.column("text"))
            decoded = bpe.digests(bpe.tokens, bounds, ids)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.diff(bounds)), lists, pa.array(decoded)], ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, decoded_sha256 string")
