"""Byte-level BPE as DuckDB recursive queries.

Texts are cut into pieces (one match of the pattern each); every distinct piece is encoded once. The bytes
of pieces are rows (piece, position, token). A recursive query joins neighbouring rows with the merge table,
and in each round contracts the leftmost pair of least rank of every piece that has one, until none
has. Decoding is an ordered aggregation of the tokens' bytes.

Where a piece is long, a round contracts not only the leftmost pair of least rank but also those that leftmost-first
order would contract next at this rank, which gives the same tokens if ranks never fall from one contraction to the
next. That holds for every text if it holds for each token of the vocabulary, encoded from its bytes: were a contraction
to make a pair of lesser rank, the bytes of that pair would be a token whose own encoding ends with this very step, as
all contractions inside these bytes so far have been its own. is_ordered() checks it, and other vocabularies are refused.

A task cuts its documents into slices of bounded size, and keeps what it has encoded in a table of bounded
size, as columns, which loses the pieces of fewest slices when it is full; nothing is shuffled. Only texts pass
through Python: what is made of them is added to their rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, lasting, named, slices, worker

#: Pieces longer than this contract all that leftmost-first order would contract at one rank in a round.
LONG_PIECE = 256
#: Rounds that one query runs for long pieces.
LONG_ROUNDS = 32
#: Bytes of the pieces of one query.
QUERY_BYTES = 128 << 10
#: Bytes of the table of pieces that a worker keeps encoded, and of text that a task holds at once, about.
KEPT_BYTES, SLICE_BYTES = 16 << 20, 2 << 20
#: Pieces that are strings of Python at once, about; texts of more characters are cut bit by bit.
CUT_PIECES, CUT_CHARS = 1 << 16, 1 << 20

#: A row is a token with its right neighbour and the token that the two make, if any. The pair that is
#: contracted takes over its right row's neighbour, the row before it sees a new neighbour, and only these
#: two meet the merge table again. Pieces without a pair to contract have no further round.
ENCODE = """
with recursive step(piece, pos, token, right_pos, right_token, merged, round) as (
  select piece, pos, token, right_pos, right_token, merges.merged, 0
  from start left join merges on pair = token::bigint * 65536 + right_token
  union all
  (with best as (
     select piece, min(merged::bigint << 32 | pos) as least, arg_min(right_pos, merged::bigint << 32 | pos) as right_pos
     from step where merged is not null group by piece),
   chosen as materialized (
     select b.piece, (b.least & 4294967295)::int as pos, (b.least >> 32)::int as merged, b.right_pos, s.right_pos as next_pos, s.right_token as next_token
     from best b join step s on s.piece = b.piece and s.pos = b.right_pos),
   changed as (
     select s.piece, s.pos, s.merged, s.round, (s.pos = c.pos or s.right_pos is not distinct from c.pos) as fresh,
            case when s.pos = c.pos then c.merged else s.token end as token,
            case when s.pos = c.pos then c.next_pos else s.right_pos end as right_pos,
            case when s.pos = c.pos then c.next_token when s.right_pos = c.pos then c.merged else s.right_token end as right_token
     from step s join chosen c on c.piece = s.piece where s.pos <> c.right_pos)
   select piece, pos, token, right_pos, right_token, case when fresh then m.merged else c.merged end, round + 1
   from changed c left join merges m on m.pair = case when fresh then token::bigint * 65536 + right_token end)
)
select s.piece, s.token, s.round from step s join (select piece, max(round) as round from step group by piece) l on l.piece = s.piece and l.round = s.round
order by s.piece, s.pos
"""

#: For long pieces a round contracts every pair of least rank; of overlapping ones every second, from the left.
ENCODE_LONG = """
with recursive step(piece, pos, token, round) as (
  select piece, pos, token, 0 from start
  union all
  (with cur as materialized (
     select piece, pos, token, round, lead(token) over w as right_token, lead(pos) over w as right_pos
     from step where round < {rounds}
     window w as (partition by piece order by pos)),
   least as materialized (
     select piece, pos, right_pos, merged from cur join merges on pair = token::bigint * 65536 + right_token
     qualify merged = min(merged) over (partition by piece)),
   runs as (
     select *, sum(fresh) over (partition by piece order by pos) as run from (
       select *, (pos is distinct from lag(right_pos) over (partition by piece order by pos))::int as fresh from least)),
   chosen as materialized (
     select piece, pos, right_pos, merged from runs
     qualify row_number() over (partition by piece, run order by pos) % 2 = 1)
   select c.piece, c.pos, coalesce(x.merged, c.token), c.round + 1
   from cur c semi join chosen on chosen.piece = c.piece
     left join chosen x on x.piece = c.piece and x.pos = c.pos
     anti join chosen y on y.piece = c.piece and y.right_pos = c.pos)
)
select piece, token, round from step
qualify round = max(round) over (partition by piece)
order by piece, pos
"""

DECODE = """
select t.piece, unhex(string_agg(v.hex, '' order by t.pos)) as bytes from tokens t join vocabulary v on v.token = t.token group by t.piece order by t.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line is a token in base 64, a blank, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def is_ordered(ranks: dict[bytes, int]) -> bool:
    """Whether each token's bytes encode to it by contractions of ranks that never fall."""
    for token in ranks:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            found = [(rank, i) for i in range(len(parts) - 1) if (rank := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found or min(found)[0] < last:
                return False
            last, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


class Vocabulary:
    """Ranks, and the tables of pairs that make a token and of the tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = [
            (left * 65_536 + right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        self.merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "merged": pa.array([m for _, m in pairs], pa.int32())})
        self.tokens = pa.table({"token": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)


class Codec:
    """Encodes and decodes pieces by recursive queries over one DuckDB connection."""

    def __init__(self, vocabulary: Vocabulary, memory: str = "200MB"):
        self.single = vocabulary.single
        self.names = pa.array(vocabulary.ranks, pa.large_binary())
        self.numbers = np.fromiter(vocabulary.ranks.values(), np.int32, len(vocabulary.ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        for name, rows in (("merges", vocabulary.merges), ("vocabulary", vocabulary.tokens)):
            self.db.register("rows", rows)
            self.db.execute(f"create table {name} as select * from rows")
        self.db.unregister("rows")

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        return self.tokens(pa.array(pieces, pa.large_binary())).to_pylist()

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        return self.joined(pa.array(ids, pa.large_list(pa.int32()))).to_pylist()

    def tokens(self, pieces: pa.LargeBinaryArray) -> pa.LargeListArray:
        """Token ids of each piece. A piece that is a token is that token."""
        whole = pc.index_in(pieces, value_set=self.names)
        is_whole = whole.is_valid().to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(pieces).to_numpy()
        at = [np.flatnonzero(is_whole)]
        made = [pa.LargeListArray.from_arrays(np.arange(len(at[0]) + 1), self.numbers[whole.drop_null().to_numpy()])]
        for some in _portions(np.flatnonzero(~is_whole & (sizes <= LONG_PIECE)), sizes):
            at.append(some)
            made.append(self._contract(ENCODE, self.single[_flat(pieces.take(some))], sizes[some])[0])
        for some in _portions(np.flatnonzero(~is_whole & (sizes > LONG_PIECE)), sizes):
            tokens, lengths = self.single[_flat(pieces.take(some))], sizes[some]
            while len(some):  # so many rounds at a time, as a query keeps the rows of all its rounds
                found, rounds = self._contract(ENCODE_LONG.format(rounds=LONG_ROUNDS), tokens, lengths)
                done, left = np.flatnonzero(rounds < LONG_ROUNDS), np.flatnonzero(rounds == LONG_ROUNDS)
                at.append(some[done])
                made.append(found.take(done))
                found, some = found.take(left), some[left]
                tokens, lengths = found.flatten().to_numpy(), found.value_lengths().to_numpy()
        return pa.concat_arrays(made).take(np.argsort(np.concatenate(at)))

    def _contract(self, query: str, token: np.ndarray, lengths: np.ndarray) -> tuple[pa.LargeListArray, np.ndarray]:
        """Tokens of each piece after the query's rounds, and how many rounds it took part in. No length is zero."""
        piece, pos = _positions(lengths)
        last = np.append(piece[1:] != piece[:-1], True)
        right = {"right_pos": pa.array(pos + 1, mask=last), "right_token": pa.array(np.append(token[1:], 0).astype(np.int32), mask=last)}
        self.db.register("start", pa.table({"piece": piece, "pos": pos, "token": token} | right))
        found = self.db.execute(query).fetchnumpy()
        ends = np.searchsorted(found["piece"], np.arange(len(lengths)), side="right")
        return pa.LargeListArray.from_arrays(np.concatenate(([0], ends)), pa.array(found["token"], pa.int32())), np.asarray(found["round"])[ends - 1]

    def joined(self, ids: pa.LargeListArray) -> pa.LargeBinaryArray:
        """The bytes of each list of ids."""
        lengths = ids.value_lengths().to_numpy().astype(np.int64)
        filled, made = np.flatnonzero(lengths), []
        for some in _portions(filled, lengths):
            piece, pos = _positions(lengths[some])
            self.db.register("tokens", pa.table({"piece": piece, "pos": pos, "token": ids.take(some).flatten()}))
            made.append(self.db.sql(DECODE).to_arrow_table().column("bytes").cast(pa.large_binary()))
        empty = np.full(len(ids) - len(filled), b"", object)
        made.append(pa.chunked_array([pa.array(empty, pa.large_binary())]))
        at = np.argsort(np.concatenate((filled, np.flatnonzero(lengths == 0))))
        return pa.concat_arrays([c for m in made for c in m.chunks]).take(at)


def _positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths, laid end to end: the list of each item and its place in it."""
    piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    return piece, (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)


def _portions(at: np.ndarray, weights: np.ndarray) -> Iterator[np.ndarray]:
    """Cut at so that the weights of a cut add up to QUERY_BYTES, or it is one item."""
    ends = np.cumsum(weights[at])
    start = 0
    while start < len(at):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + QUERY_BYTES, side="right"))
        end = max(end, start + 1)
        yield at[start:end]
        start = end


def _flat(values: pa.LargeBinaryArray) -> np.ndarray:
    """The bytes of all values, end to end."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


class Encoder:
    """Encodes whole texts: cuts them into pieces and asks the codec for pieces it hasn't kept."""

    def __init__(self, codec: Codec, pattern: str):
        self.codec, self.pattern = codec, regex.compile(pattern)
        #: Pieces with their tokens and what these decode to, and in how many slices each was, halved when the table was full.
        self.kept = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.large_string(), pa.large_list(pa.int32()), pa.large_binary())], ["piece", "ids", "decoded"])
        self.uses = np.zeros(0, np.int32)
        self.decimals = pa.array(map(str, range(int(codec.numbers.max()) + 1)), pa.large_string())

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Where the pieces of each text begin and end, and the pieces of all texts."""
        made, some, ends, n = [], [], [0], 0

        def put() -> None:
            made.append(pa.array(some, pa.large_string()))
            some.clear()

        for text in texts:
            text = text.as_py() or ""
            if len(text) <= CUT_CHARS:
                found = self.pattern.findall(text)
                n += len(found)
                some += found
            else:
                matches = self.pattern.finditer(text)
                while found := [m[0] for m in islice(matches, CUT_PIECES)]:
                    n += len(found)
                    some += found
                    put()
            ends.append(n)
            if len(some) >= CUT_PIECES:
                put()
        put()
        return np.array(ends, np.int64), pa.concat_arrays(made).dictionary_encode()

    def lookup(self, pieces: pa.LargeStringArray) -> tuple[pa.LargeListArray, pa.LargeBinaryArray]:
        """Tokens of each of these distinct pieces, and what they decode to."""
        at = pc.index_in(pieces, value_set=self.kept.column("piece"))
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().copy()
        self.uses[at[~new]] += 1
        at[new] = len(self.kept) + np.arange(new.sum())
        missing = pieces.filter(pa.array(new))
        ids = self.codec.tokens(missing.cast(pa.large_binary()))
        made = pa.RecordBatch.from_arrays([missing, ids, self.codec.joined(ids)], self.kept.schema.names)
        self.kept = pa.concat_batches([self.kept, made])
        self.uses = np.append(self.uses, np.ones(len(made), np.int32))
        found = self.kept.column("ids").take(at), self.kept.column("decoded").take(at)
        if self.kept.nbytes > KEPT_BYTES:
            self._shrink()
        return found

    def _shrink(self) -> None:
        """Keep the pieces of most slices, of as many the newest, in half of the bytes."""
        piece, ids, decoded = self.kept.columns
        sizes = 24 + sum(x.to_numpy() for x in (pc.binary_length(piece), pc.multiply(ids.value_lengths(), 4), pc.binary_length(decoded)))
        order = np.lexsort((np.arange(len(sizes)), self.uses))[::-1]
        stay = np.sort(order[np.cumsum(sizes[order]) <= KEPT_BYTES // 2])
        self.kept, self.uses = self.kept.take(pa.array(stay)), (self.uses[stay] + 1) // 2

    def encode(self, texts: pa.Array) -> tuple[pa.LargeListArray, pa.Array, pa.Array]:
        """ids, their numbers, and decoded bytes of each text."""
        ends, pieces = self.cut(texts)
        ids, decoded = self.lookup(pieces.dictionary)
        at = pieces.indices
        ids, decoded = ids.take(at), decoded.take(at)
        ends_of_ids = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))[ends]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(ends, decoded), pa.scalar(b"", pa.large_binary()))
        return pa.LargeListArray.from_arrays(ends_of_ids, ids.flatten()), pa.array(np.diff(ends_of_ids)), joined

    def written(self, ids: pa.LargeListArray) -> pa.Array:
        """ids in decimal form, joined by blanks."""
        return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, self.decimals.take(ids.values)), pa.scalar(" ", pa.large_string()))


@lasting
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


@lasting
def _encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker, so that what it has encoded is of use to the next."""
    return Encoder(Codec(_vocabulary(path)), pattern)


@lru_cache(maxsize=8)
def _checked(path: str) -> str:
    if not is_ordered(read_ranks(path)):
        raise ValueError(f"not the ranks of a byte pair encoding: {path}")
    return path


#: What may be made of a text, and its type.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def coder(path: str, pattern: str, outputs: tuple[str, ...]):
    """The column function from texts to a struct of the named outputs. A null text is an empty one."""
    path = _checked(path)

    def digest(values: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())

    made = {
        "ids": lambda encoder, ids, n, decoded: ids.cast(pa.list_(pa.int32())),
        "n_tokens": lambda encoder, ids, n, decoded: n,
        "decoded": lambda encoder, ids, n, decoded: decoded.cast(pa.binary()),
        "ids_sha256": lambda encoder, ids, n, decoded: digest(encoder.written(ids)),
        "decoded_sha256": lambda encoder, ids, n, decoded: digest(decoded),
    }

    @F.arrow_udf(", ".join(f"{name} {OUTPUTS[name]}" for name in outputs))
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with worker(_vocabulary, _encoder):
            encoder = _encoder(path, pattern)
            for texts in batches:
                parts = []
                for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE_BYTES):
                    coded = encoder.encode(part.column("text"))
                    parts.append(pa.StructArray.from_arrays([made[name](encoder, *coded) for name in outputs], list(outputs)))
                    del coded
                    give_back()  # a slice leaves many times its size
                if not parts:
                    coded = encoder.encode(pa.array([], pa.string()))
                    parts.append(pa.StructArray.from_arrays([made[name](encoder, *coded) for name in outputs], list(outputs)))
                parts[:] = [pa.concat_arrays(parts)]
                yield parts.pop()  # so that nothing made is held twice, or until the next batch

    return code


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens", "decoded")
) -> DataFrame:
    """Return row (a struct of docs without the text) and the outputs for every row of docs.

    outputs: some of ids (array), n_tokens, decoded (binary), ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256. path: the rank file, at the same place on every machine. A null text is an empty one, which has no
    ids. Texts of any length are encoded whole. Repeated rows are encoded each; ids are those of the tiktoken library
    without special tokens. An empty table gives no rows. Columns of docs may have any names, as they are in row.
    """
    kept = [named(c).alias(c) for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    coded = docs.select(F.struct(*kept).alias("row"), coder(path, pattern, outputs)(named(text)).alias("coded"))
    return coded.select("row", *[F.col("coded")[name].alias(name) for name in outputs])


def encode_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what encode_documents returns."""
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode_documents(rows, path, pattern, outputs=outputs).select("row.doc_id", *outputs)
