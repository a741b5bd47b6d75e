"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

Texts up to ``giant`` characters are encoded by the library. A longer one is normalised as a whole and cut into chunks
that are worked on apart, with the library's result:

* Byte-pair merging has local consistency: a sequence of pieces is the encoding of a text if and only if merging each
  two neighbours' text alone gives these two pieces. So an encoding is a path through (end, piece) whose steps are
  consistent pairs; each step weighs -1, an inconsistent one minus infinity.
* The boundary state of a chunk is the piece over its first boundary's left neighbour: its text and how far it
  reaches into the chunk. Each chunk yields the transfer matrix from all entry states to all exit states: the best
  path's weight, so minus the number of pieces.
* Matrices combine in the max-plus semiring, associatively: by blocks of chunks first, then over the blocks from the
  text's known start, then inside each block again. That gives each chunk its own entry and exit state.
* Each chunk is then backtraced by itself, between its states; its pieces are put together by text.

Null and empty texts have no pieces. Giant texts are worked on once for each distinct text; repeated rows return
equal values. Decoding gives the text back unless it holds U+2581, which the model's alphabet can't tell from a
space; ``round_trip`` says whether it did.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_batches, materialise, text_or_empty

GIANT, CHUNK, BLOCK = 1 << 16, 1 << 14, 64
NEVER = float("-inf")
State = tuple[int, str]  # how far the piece reaches beyond the boundary, its text


class Merges:
    """Byte-pair merging by a model's pieces and scores; scores rank merges, and the leftmost goes first on ties."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.heads = {p[:k] for p in scores for k in range(1, len(p) + 1)}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def encode(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def whole(self, piece: str) -> bool:
        """Can the piece come out of merging at all?"""
        if piece not in self._whole:
            self._whole[piece] = self.encode(piece) == [piece]
        return self._whole[piece]

    def consistent(self, left: str, right: str) -> bool:
        if not left:
            return True
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            found = self._pairs[left, right] = self.encode(left + right) == [left, right]
        return found

    def at(self, text: str, i: int) -> Iterator[str]:
        """Pieces that may begin at place i: those of the model, and any single character."""
        yield text[i]
        for k in range(2, self.longest + 1):
            piece = text[i : i + k]
            if len(piece) < k or piece not in self.heads:
                return
            if piece in self.scores and self.whole(piece):
                yield piece


def entries(merges: Merges, text: str, boundary: int) -> list[State]:
    """All states at a boundary inside a text."""
    if not boundary:
        return [(0, "")]
    out = []
    for i in range(max(0, boundary - merges.longest), boundary):
        out += [(i + len(p) - boundary, p) for p in merges.at(text, i) if i + len(p) >= boundary]
    return sorted(out)


def _paths(merges: Merges, text: str, begin: int, end: int, start: list[State]):
    """Forward over (end, piece) from all start states at once. Gives nodes: place -> piece -> (weights, step back)."""
    nodes: dict[int, dict[str, tuple[np.ndarray, tuple[int, str] | None]]] = {}
    for k, (reach, piece) in enumerate(start):
        weights = np.full(len(start), NEVER)
        weights[k] = 0
        nodes.setdefault(begin + reach, {})[piece] = (weights, None)
    for i in range(begin, end):
        for left, (weights, _) in nodes.get(i, {}).items():
            for piece in merges.at(text, i):
                if merges.consistent(left, piece):
                    there = nodes.setdefault(i + len(piece), {})
                    if piece in there:
                        there[piece] = (np.maximum(there[piece][0], weights - 1), there[piece][1] if (there[piece][0] >= weights - 1).all() else (i, left))
                    else:
                        there[piece] = (weights - 1, (i, left))
    return nodes


def transfer(merges: Merges, text: str, begin: int, end: int) -> tuple[list[State], list[State], np.ndarray]:
    """(entry states, exit states, matrix) of the chunk text[begin:end]; the text reaches a piece beyond both ends."""
    start = entries(merges, text, begin)
    nodes = _paths(merges, text, begin, end, start)
    leave = sorted((place - end, piece) for place, at in nodes.items() if place >= end for piece in at)
    matrix = np.array([nodes[end + reach][piece][0] for reach, piece in leave]).T if leave else np.empty((len(start), 0))
    return start, leave, matrix


def combine(a, b):
    """Max-plus product of two neighbouring chunks' transfers; associative."""
    (start, middle, x), (begin, leave, y) = a, b
    at = {s: i for i, s in enumerate(begin)}
    rows = [(j, at[s]) for j, s in enumerate(middle) if s in at]
    if not rows or not leave:
        return start, [], np.empty((len(start), 0))
    left, right = x[:, [j for j, _ in rows]], y[[i for _, i in rows]]
    product = (left[:, :, None] + right[None]).max(1)
    alive = np.flatnonzero((product > NEVER).any(0))
    return start, [leave[k] for k in alive], product[:, alive]


def through(reached: dict[State, tuple[float, State | None]], chunk) -> dict[State, tuple[float, State | None]]:
    """The exit states that entry states (with the weights of their best paths) lead to: best weight and state before."""
    start, leave, matrix = chunk
    places = {s: i for i, s in enumerate(start)}
    out: dict[State, tuple[float, State | None]] = {}
    for state, (weight, _) in reached.items():
        if state in places:
            row = matrix[places[state]]
            for k in np.flatnonzero(row > NEVER):
                if leave[k] not in out or weight + row[k] > out[leave[k]][0]:
                    out[leave[k]] = (weight + row[k], state)
    return out


def backtrace(merges: Merges, text: str, begin: int, end: int, entry: State, leave: State) -> list[str]:
    """The chunk's pieces: those after the entry state's, up to and with the exit state's."""
    nodes = _paths(merges, text, begin, end, [entry])
    out, place, piece = [], end + leave[0], leave[1]
    while (back := nodes[place][piece][1]) is not None:
        out.append(piece)
        place, piece = back
    return out[::-1]


@functools.cache
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def merges_of(path: str) -> Merges:
    model = load(path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Merges({model.id_to_piece(i): model.get_score(i) for i in plain})


def ids_of(path: str, parts: list[str]) -> list[int]:
    """Pieces' ids; characters that the model lacks become bytes."""
    model, known, out = load(path), merges_of(path).scores, []
    for p in parts:
        out += [model.piece_to_id(p)] if p in known else [model.piece_to_id(f"<0x{b:02X}>") for b in p.encode()]
    return out


def _states(states: list[State]) -> pa.Array:
    return [{"reach": r, "piece": p} for r, p in states]


_STATE = "array<struct<reach: int, piece: string>>"
CHUNKS = "digest binary, chunk int, before int, size int, body string"
MATRIX = f"digest binary, chunk int, start {_STATE}, leave {_STATE}, matrix array<double>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_PA_STATES = pa.list_(pa.struct([("reach", pa.int32()), ("piece", pa.string())]))
_PA_MATRIX = pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("start", _PA_STATES), ("leave", _PA_STATES), ("matrix", pa.list_(pa.float64()))])


def _pack(digest: bytes, chunk: int, t) -> dict:
    return {"digest": digest, "chunk": chunk, "start": _states(t[0]), "leave": _states(t[1]), "matrix": t[2].ravel().tolist()}


def _unpack(row: dict):
    start, leave = ([(s["reach"], s["piece"]) for s in row[k]] for k in ("start", "leave"))
    return start, leave, np.array(row["matrix"], "f8").reshape(len(start), len(leave))


def _giant_ids(giants: DataFrame, path: str, chunk: int, block: int) -> DataFrame:
    """(digest, ids, decoded_digest) of distinct (digest, text)."""

    def cut(batches):
        margin = merges_of(path).longest
        for row in _rows(batches):
            text = load(path).normalize(row["text"])
            for k, at in enumerate(range(0, len(text), chunk)):
                a = max(0, at - margin)
                yield _emit([{"digest": row["digest"], "chunk": k, "before": at - a, "size": min(chunk, len(text) - at), "body": text[a : at + chunk + margin]}], pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("before", pa.int32()), ("size", pa.int32()), ("body", pa.string())]))

    parts = int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # chunks are few bytes and much work, so their partitions aren't left to be joined by size
    chunks = materialise(giants.mapInArrow(cut, CHUNKS).repartition(parts, "digest", "chunk"), "chunks")

    def matrices(batches):
        for row in _rows(batches):
            yield _emit([_pack(row["digest"], row["chunk"], transfer(merges_of(path), row["body"], row["before"], row["before"] + row["size"]))], _PA_MATRIX)

    own = materialise(chunks.mapInArrow(matrices, MATRIX), "matrices")

    def product(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        return pa.Table.from_pylist([_pack(rows[0]["digest"], rows[0]["chunk"] // block, functools.reduce(combine, map(_unpack, rows)))], _PA_MATRIX)

    blocks = own.withColumn("block", F.expr(f"chunk div {block}")).groupBy("digest", "block").applyInArrow(lambda t: product(t.drop_columns("block")), MATRIX)
    state = "struct<reach: int, piece: string>"
    pa_walk = pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("entry", _PA_STATES.value_type), ("leave", _PA_STATES.value_type)])
    walk = f"digest binary, chunk int, entry {state}, leave {state}"

    def follow(rows: list[dict], entry: State, leave: State | None) -> list[dict]:
        """Each row's entry and exit state on the path of most weight from entry (to leave, where it's known)."""
        layers: list[dict] = [{entry: (0.0, None)}]
        for row in rows:
            layers.append(through(layers[-1], _unpack(row)))
        last = leave if leave is not None else max((s for s in layers[-1] if s[0] == 0), key=lambda s: layers[-1][s][0])
        out = []
        for row, layer in zip(reversed(rows), reversed(layers[1:])):
            out.append({"digest": row["digest"], "chunk": row["chunk"], "entry": dict(zip(("reach", "piece"), layer[last][1])), "leave": dict(zip(("reach", "piece"), last))})
            last = layer[last][1]
        return out[::-1]

    def over_blocks(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        return pa.Table.from_pylist(follow(rows, (0, ""), None), pa_walk)

    ends = blocks.groupBy("digest").applyInArrow(over_blocks, walk).withColumnRenamed("chunk", "block")

    def in_block(left: pa.Table, right: pa.Table) -> pa.Table:
        end, rows = right.to_pylist()[0], sorted(left.drop_columns("block").to_pylist(), key=lambda r: r["chunk"])
        return pa.Table.from_pylist(follow(rows, (end["entry"]["reach"], end["entry"]["piece"]), (end["leave"]["reach"], end["leave"]["piece"])), pa_walk)

    by_block = own.withColumn("block", F.expr(f"cast(chunk div {block} as int)")).groupBy("digest", "block")
    steps = by_block.cogroup(ends.withColumn("block", F.col("block").cast("int")).groupBy("digest", "block")).applyInArrow(in_block, walk)

    def trace(batches):
        for row in _rows(batches):
            entry, leave = ((row[k]["reach"], row[k]["piece"]) for k in ("entry", "leave"))
            ids = ids_of(path, backtrace(merges_of(path), row["body"], row["before"], row["before"] + row["size"], entry, leave))
            yield _emit([{"digest": row["digest"], "chunk": row["chunk"], "ids": ids}], pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    pieces = chunks.join(steps, ["digest", "chunk"]).mapInArrow(trace, "digest binary, chunk int, ids array<int>")
    whole = pieces.groupBy("digest").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))

    def decode(batches):
        for row in _rows(batches):
            yield _emit([row | {"decoded": load(path).decode(row["ids"])}], pa.schema([("digest", pa.binary()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    decoded = whole.mapInArrow(decode, "digest binary, ids array<int>, decoded string")
    return decoded.select("digest", "ids", (F.unhex(F.sha2("decoded", 256)) == F.col("digest")).alias("round_trip"))


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", giant: int = GIANT, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, ids, round_trip) of every row."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column("text").to_pylist()
                ids = [model.encode_as_numpy(t) for t in texts]
                back = [model.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                offsets = np.cumsum([0, *map(len, ids)]).astype("i4")
                flat = np.concatenate(ids).astype("i4") if ids else np.empty(0, "i4")
                n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, pa.array(np.diff(offsets).astype("i8")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(back, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "ids", "round_trip"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    small = own.filter(F.length("text") <= giant).mapInArrow(encode, f"doc_id {id_type}, n_bytes long, n_tokens long, ids array<int>, round_trip boolean")
    large = own.filter(F.length("text") > giant).withColumn("digest", F.unhex(F.sha2("text", 256)))
    encoded = _giant_ids(large.select("digest", "text").dropDuplicates(["digest"]), path, chunk, block)
    named = large.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(encoded, "digest")
    return small.unionAll(named.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip"))
