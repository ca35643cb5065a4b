"""Byte-level BPE by backtracking over longest matches.

The vocabulary is put into an Aho-Corasick automaton whose letters are bytes as Latin-1
characters. Merging by rank never has to be simulated: a sequence of tokens is the result of the
merges exactly if every two neighbours stay apart, which depends on the two tokens alone and is
remembered. Encoding therefore takes the longest match, goes on while neighbours fit, takes the
next shorter prefix where they do not, and never enters a position twice that led nowhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sentrel.llm.common import read_ranks, slices, tokenizer_path, whole

#: White space as the tokenizers' pattern means it (the Unicode property).
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the split pattern crosses the borders of these chunks, so chunks can be cached.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A space beside white space.
_ODD = re.compile(f"[{_WS}] | [{_WS}]")
#: Entries of a worker's cache of chunks; a full cache is emptied.
CACHE_ENTRIES = 300_000
#: Longer chunks are not cached.
CACHE_CHARS = 64


class Codec:
    """Encoder and decoder for a table of token bytes and ranks.

    A piece that is a token itself gets that token, as the reference library does; tokens that no
    order of merges makes are left out of the automaton.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        # A letter is no merge: it comes before all of them, whatever its rank.
        tokens = sorted(ranks, key=lambda t: (len(t) > 1, ranks[t]))
        number = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.bytes = {ranks[t]: t for t in tokens}
        self.ids = [ranks[t] for t in tokens]
        self.size = [len(t) for t in tokens]
        self.whole = number
        # The pair of tokens that a token is made of; a letter is its own pair.
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.shorter: list[int] = [-1] * len(tokens)
        self.pairs: dict[tuple[int, int], int] = {}
        self.fit: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # Ids of chunks seen before; those of ``spaced`` stand there without their leading space.
        self.bare: dict[str, tuple[int, ...]] = {}
        self.spaced: dict[str, tuple[int, ...]] = {}
        made = {}
        for i, token in enumerate(tokens):
            text = token.decode("latin-1")
            parts = self._merge(text, number, i) if len(text) > 1 else [i]
            if len(parts) == 2:
                self.left[i], self.right[i] = parts
                self.pairs[parts[0], parts[1]] = i
            elif len(parts) > 2:
                continue
            made[text] = i
            self.automaton.add_word(text, i)
        for text, i in made.items():
            self.shorter[i] = next((made[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in made), -1)
        self.automaton.make_automaton()

    @staticmethod
    def _merge(text: str, number: dict[str, int], below: int) -> list[int]:
        """Merge a token's letters with the tokens before it (used to set up the table only)."""
        parts = list(text)
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                n = number.get(parts[i] + parts[i + 1], below)
                if n < best:
                    best, at = n, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [number.get(p, -1) for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side; remembered."""
        key = a << 32 | b
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) >= 4 * CACHE_ENTRIES:
                self.fit.clear()
            known = self.fit[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo the later of the two last merges step by step; were the inner ends ever joined by
        # a merge that comes before the ones undone so far, the two could not have formed.
        left, right, pairs = self.left, self.right, self.pairs
        limit = len(left)
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                if left[a] == a:
                    return True
                limit, a = a, right[a]
            elif left[b] != b:
                # Of equal tokens the left one is merged first, so a tie does not count as earlier.
                limit, b = b + 1, left[b]
            elif left[a] != a:
                limit, a = a, right[a]
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1 of its bytes."""
        found = self.whole.get(piece)
        if found is not None:
            return (self.ids[found],)
        size, shorter, known, fits = self.size, self.shorter, self.fit.get, self.fits
        ids = self.ids
        # The longest matches one after another are often right, and then nothing else is needed.
        out = [token for _, token in self.automaton.iter_long(piece)]
        last = out[0]
        for token in out[1:]:
            if not (fits(last, token) if (fit := known(last << 32 | token)) is None else fit):
                break
            last = token
        else:
            return tuple([ids[t] for t in out])
        n = len(piece)
        longest = [-1] * n
        for end, token in self.automaton.iter(piece):
            longest[end + 1 - size[token]] = token  # ends rise, so the longest comes last
        dead: set[int] = set()
        out = []
        at, last, token = 0, -1, longest[0]
        while True:
            if last < 0 or (fits(last, token) if (fit := known(last << 32 | token)) is None else fit):
                end = at + size[token]
                if end not in dead:
                    out.append(token)
                    if end == n:
                        break
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                if not out:
                    raise ValueError("a byte of the text is not in the vocabulary")
                dead.add(at)
                last = out.pop()
                at -= size[last]
                token = shorter[last]
                last = out[-1] if out else -1
        return tuple([ids[t] for t in out])

    def _ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk, piece by piece; what is not too long is remembered."""
        pieces = self.split.findall(chunk)
        if len(pieces) == 1:
            ids = self.encode_piece(chunk.encode().decode("latin-1"))
        else:
            ids = tuple(chain.from_iterable([self._known(p) for p in pieces]))
        if len(chunk) <= CACHE_CHARS:
            if len(self.bare) + len(self.spaced) >= CACHE_ENTRIES:
                self.bare.clear()
                self.spaced.clear()
            if chunk[:1] == " ":
                self.spaced[chunk[1:]] = ids
            else:
                self.bare[chunk] = ids
        return ids

    def _known(self, chunk: str) -> tuple[int, ...]:
        found = self.spaced.get(chunk[1:]) if chunk[:1] == " " else self.bare.get(chunk)
        return found or self._ids(chunk)

    def encode(self, text: str) -> list[int]:
        if _ODD.search(text):
            return list(chain.from_iterable([self._known(c) for c in _CHUNK.findall(text)]))
        # Every space stands alone between other letters: it begins a chunk.
        first, *rest = text.split(" ")
        known, make = self.spaced.get, self._ids
        parts = [known(c) or make(" " + c) for c in rest]
        return list(chain(self._known(first) if first else (), chain.from_iterable(parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@cache
def _codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def codec(rank_file: str) -> Codec:
    """The codec of a public rank file, set up once per worker."""
    import public_tokenizers

    return _codec(tokenizer_path(rank_file), public_tokenizers.PATTERN)


def encode(docs: DataFrame, rank_file: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``: the token ids of every whole text, without special tokens.

    Null and empty texts get an empty list. Texts are not deduplicated, ordered or shuffled; rows
    and other columns stay as they are, but a column named ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    source = docs.select(*[f"`{c}`" for c in kept], whole(text).alias("__text"))
    fields = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file)
        for batch in slices(batches, "__text", 1 << 21):
            ids = pa.array([bpe.encode(t) for t in batch.column("__text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(kept))] + [ids], [*kept, out])

    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, rank_file: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that a list of ids stands for (binary; null ids: null)."""
    kept = [c for c in docs.columns if c != out]
    fields = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file)
        for batch in slices(batches, ids):
            made = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, out]
            )

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass: counts and digests of both directions.

    Returns the key column, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (the bytes that the ids decode to), one row per row of ``docs``. Null texts
    count as empty: no tokens, digests of nothing.
    """
    source = docs.select(f"`{key}`", whole(text).alias("__text"))
    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file)
        written = {i: str(i) for i in bpe.bytes}.__getitem__
        sha = hashlib.sha256
        for batch in slices(batches, "__text"):
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column("__text"):
                ids = bpe.encode(value.as_py())
                counts.append(len(ids))
                ids_sha.append(sha(",".join(map(written, ids)).encode()).hexdigest())
                text_sha.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``token_ids``, ``n_tokens`` and ``ok``: the ids decode to the text.

    Encoding and decoding happen in one pass; other columns stay, null texts count as empty.
    """
    made = ("token_ids", "n_tokens", "ok")
    kept = [c for c in docs.columns if c not in (text, *made)]
    schema = T.StructType(
        [f for f in docs.schema.fields if f.name in kept]
        + [
            T.StructField("token_ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ok", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file)
        for batch in slices(batches, "__text", 1 << 21):
            ids, ok = [], []
            for value in batch.column("__text"):
                said = value.as_py()
                ids.append(bpe.encode(said))
                ok.append(bpe.decode(ids[-1]) == said.encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(kept))]
                + [
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ok, pa.bool_()),
                ],
                [*kept, *made],
            )

    return docs.select(*[f"`{c}`" for c in kept], whole(text).alias("__text")).mapInArrow(run, schema)
