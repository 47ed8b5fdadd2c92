"""Best-fit packing of documents into fixed-length sequences, after dominance reduction.

Full pieces of long documents are sequences by themselves.  The rest is a bin
packing whose items differ in length alone, so the plan is made on the counts per
length (at most ``capacity`` numbers, whatever the corpus): Martello-Toth reduction
fixes small sets that dominate all others holding the longest item, best-fit packs
what it leaves, and equal sequences become one pattern with a multiplicity.  Pieces
are then dealt to the patterns' places by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicelake.llm import kernel as K
from choicelake.llm.common import kept_by_worker, local_table, stored
from choicelake.llm.tokens import Vocabulary, byte_letters

END = 2
#: Lengths are dealt out in so many lanes each, so that no length is one task's work.
LANES = 4096
#: A row's number in its file, of which a few values do: tells repeated rows apart.
TURN = "turn"
#: Parts of texts whose ids a worker remembers; when full it starts anew.
REMEMBERED = 1 << 19
#: New parts that the library is asked for at once.
GROUP = 48


class Counts:
    """A multiset of lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, many: int = 1) -> None:
        left = self.n[length] - many
        if left < 0:
            raise ValueError(length)
        if left:
            self.n[length] = left
        else:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def put(self, length: int, many: int = 1) -> None:
        if length not in self.n:
            insort(self.keys, length)
        self.n[length] = self.n.get(length, 0) + many

    def at_most(self, length: int) -> int | None:
        i = bisect_right(self.keys, length)
        return self.keys[i - 1] if i else None


def _best_pair(free: Counts, room: int) -> tuple[int, int] | None:
    """The two lengths with the largest sum of at most ``room``."""
    best, keys = None, free.keys
    i, j = 0, len(keys) - 1
    while i <= j:
        total = keys[i] + keys[j]
        if total > room or (i == j and free.n[keys[i]] < 2):
            j -= 1
            continue
        if best is None or total > sum(best):
            best = (keys[j], keys[i])
        i += 1
    return best


def _smallest(free: Counts, many: int) -> int:
    """The sum of the ``many`` least lengths; beyond any room if there are fewer."""
    total = 0
    for key in free.keys:
        took = min(many, free.n[key])
        total, many = total + took * key, many - took
        if not many:
            return total
    return 1 << 60


def _largest_second(free: Counts, room: int) -> int:
    """The largest smaller member of any two lengths that fit together; 0 if no two do."""
    i = bisect_right(free.keys, room // 2) - 1
    while i >= 0:
        y = free.keys[i]
        if free.n[y] >= 2 or (i + 1 < len(free.keys) and y + free.keys[i + 1] <= room):
            return y
        i -= 1
    return 0


def _dominating(free: Counts, room: int) -> tuple[int, ...] | None:
    """The set of at most two lengths that dominates every set fitting ``room``, if there is one."""
    single = free.at_most(room)
    if single is None:
        return ()
    if single == room or _smallest(free, 2) > room:
        return (single,)
    if _smallest(free, 3) <= room:
        return None
    best = _best_pair(free, room)
    if best is None or single >= sum(best):
        return (single,)
    free.take(single)
    mate = free.at_most(room - single)
    free.put(single)
    return (single, mate) if mate is not None and mate >= _largest_second(free, room) else None


def reduce(counts: dict[int, int], capacity: int) -> tuple[Counter, dict[int, int]]:
    """Fix dominating sets: ({pattern: how often}, lengths left over).

    Every length w, the longest first, is tried with its room r = capacity - w.  The
    largest single length s that fits dominates every set when s = r, when no two
    lengths fit, or when no three fit and s is at least the best pair's sum.  A pair (a, b)
    dominates when no three fit, a is the largest that fits at all, b the largest that
    fits beside it, and no fitting pair has a smaller member over b.  As what is fixed only
    takes alternatives away, a set stays dominating for as long as its lengths last, so
    it is fixed that often at once.
    """
    free, fixed = Counts(counts), Counter()
    w = free.keys[-1] if free.keys else None
    while w is not None:
        many = free.n.get(w, 0)
        if many:
            free.take(w)
            chosen = _dominating(free, capacity - w)
            if chosen is not None:
                need = Counter(chosen)
                need[w] += 1
                free.put(w)
                times = min(free.n[x] // c for x, c in need.items())
                for x, c in need.items():
                    free.take(x, c * times)
                fixed[tuple(sorted((w, *chosen), reverse=True))] += times
                continue
            free.put(w)
        w = free.at_most(w - 1)
    return fixed, free.n


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Longest first, each into the fullest sequence that has room: {pattern: how often}.

    Sequences with the same contents are handled together.
    """
    open_: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []
    done: Counter = Counter()

    def add(pattern: tuple, many: int, room: int) -> None:
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + many

    for length in sorted(counts, reverse=True):
        many = counts[length]
        while many:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = min(capacity // length, many)
                add((length,) * each, many // each, capacity - each * length)
                many -= many // each * each
                continue
            room = rooms[i]
            pattern, there = open_[room].popitem()
            took = min(there, many)
            if took < there:
                open_[room][pattern] = there - took
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            add((*pattern, length), took, room - length)
            many -= took
    for group in open_.values():
        done.update(group)
    return done


def plan(counts: dict[int, int], capacity: int) -> Counter:
    """{lengths of a sequence: how many such sequences}, for all items of ``counts``."""
    fixed, left = reduce(counts, capacity)
    if left:
        fixed.update(best_fit(left, capacity))
    return fixed


class Encoder:
    """Ids, as little-endian bytes, as the ``tokenizers`` library gives them without added special tokens.

    In byte-level vocabularies no word runs over a blank between two marks that are none, and a
    token that starts with a blank starts a word.  So the library is asked once for all new
    parts from one blank to the next, and for a whole text where blanks follow one another
    or other spaces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        vocab = Vocabulary(path)
        self.own, blank = Tokenizer.from_file(path), byte_letters()[32]
        self.starts = np.zeros(max(vocab.ids.values(), default=0) + 1 + len(vocab.specials), bool)
        self.starts[[i for word, i in vocab.ids.items() if word.startswith(blank) and word not in vocab.specials]] = True
        self.by_parts = not any(" " in s or s.startswith(blank) for s in vocab.specials)
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known parts one after another (none for -1), and where each ends."""
        length = np.where(numbers < 0, 0, self.bounds[numbers + 1] - self.bounds[numbers])
        ends = np.cumsum(length)
        return self.ids[np.repeat(self.bounds[numbers] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)], ends

    def keep(self, parts: list[str]) -> None:
        """Forget all but these."""
        kept = [p for p in parts if p in self.known]
        ids, ends = self.gather(np.array([self.known[p] for p in kept], np.int64))
        self.known, self.ids, self.bounds = {p: i for i, p in enumerate(kept)}, ids, np.append(0, ends)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Which known part each is, once they are known; -1 for those that begin or end with a space or are empty."""
        found = np.fromiter((self.known.get(p, -1) for p in parts), np.int64, len(parts))
        at = [i for i in np.flatnonzero(found < 0).tolist() if (p := parts[i]) and not p[0].isspace() and not p[-1].isspace()]
        if at:
            new = [parts[i] for i in at]
            # the library is fastest at some dozens of words
            ids = np.concatenate([self.whole(" " + " ".join(new[i : i + GROUP])) for i in range(0, len(new), GROUP)])
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) != len(new):
                raise ValueError("a part does not start with a blank's token")
            found[at] = np.arange(len(new)) + len(self.known)
            self.known.update(zip(new, found[at].tolist()))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.append(cuts[1:], len(ids))])
            self.ids = np.concatenate([self.ids, ids])
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return [self.whole(t).tobytes() for t in texts]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        parts = split.flatten().dictionary_encode()
        names = parts.dictionary.to_pylist()
        if len(self.known) + len(names) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.keep(names)
        number = self.numbers(names)[parts.indices.to_numpy()]
        first = offsets[:-1]
        odd = number < 0
        odd[first] = False
        odd = np.logical_or.reduceat(odd, first).tolist() if len(first) else []
        # the first parts have no blank before them
        number[first] = -1
        ids, ends = self.gather(number)
        data = ids.tobytes()
        cuts = np.concatenate([[0], ends[offsets[1:] - 1]]) * 4
        out = []
        for text, strange, a, b in zip(texts, odd, cuts.tolist(), cuts[1:].tolist()):
            start = text.split(" ", 1)[0]
            if strange or start[-1:].isspace() or (not start and text):
                out.append(self.whole(text).tobytes())
            else:
                out.append(self.whole(start).tobytes() + data[a:b])
        return out


@kept_by_worker
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, path: str, capacity: int = 1024, end: int = END, ids: bool = True,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A document is its ids then ``end`` (a null or empty text: ``end`` alone).  Longer ones are cut
    into pieces of ``capacity``, the first of which takes what is left over.
    """
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            keys = batch["doc_id"]
            for at, texts in K.pieces(batch["text"], 4 * K.PIECE):
                rows = []
                for key, value in zip(keys.iloc[at : at + len(texts)], encode(texts)):
                    found = np.frombuffer(value + last, "<u4")
                    bounds = [0, *range((len(found) - 1) % capacity + 1, len(found) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        part = found[a:b]
                        rows.append((key, n, a, b - a, zlib.crc32(part.tobytes()), *([part.astype("int32")] if ids else [])))
                yield pd.DataFrame(rows, columns=names)

    names = [x.split()[0] for x in out.split(", ")]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInPandas(_nullable(cut_up), out)


def _nullable(function):
    """Keep null ids through pandas, which would make a long with nulls a float."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def exact(it):
            for batch in it:
                if batch["doc_id"].dtype.kind == "f":
                    batch = batch.assign(doc_id=batch["doc_id"].astype("Int64"))
                yield batch

        for out in function(exact(batches)):
            yield out.assign(doc_id=pd.array(out["doc_id"], dtype="Int64"))

    return run


def assign(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (a stored table with a ``length``) with sequence_id and offset.

    What reaches the driver is a count per length; what is broadcast is the plan, a few
    places per pattern, and the lanes' first ranks: both bounded by ``capacity``, not by
    the corpus.  A piece's rank within its length is its place in a lane plus the
    lane's first rank, so a length that a third of all pieces share is still many
    tasks' work.
    """
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < capacity)
    # by content, so that the same table is packed alike, and by turns where rows are repeated
    turn = [c for c in pieces.columns if c == TURN]
    lane = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *turn), F.lit(LANES)).cast("int")
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = sorted(plan(counts, capacity).items(), reverse=True)

    places, rank, sequence = [], Counter(), 0
    for pattern, many in patterns:
        offset = 0
        for length in pattern:
            places.append((length, rank[length], rank[length] + many, sequence, offset))
            rank[length] += many
            offset += length
        sequence += many
    names = ("p_length", "rank_from", "rank_to", "first_sequence", "offset")
    spots_df = local_table(spark, **dict(zip(names, zip(*_merged(places)) if places else [()] * len(names))))

    # lanes: rank within (length, lane), then that plus the rows of the lanes before
    laned = short.withColumn("lane", lane)
    per_lane = laned.groupBy("length", "lane").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    firsts = per_lane.withColumn(
        "first_rank", F.sum("n").over(Window.partitionBy("length").orderBy("lane")) - F.col("n")
    ).select("length", "lane", "first_rank")
    ranked = laned.withColumn(
        "in_lane", F.row_number().over(Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32"))
    ).join(firsts, ["length", "lane"]).withColumn("rank", F.col("first_rank") + F.col("in_lane") - 1)
    dealt = ranked.join(
        F.broadcast(spots_df),
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    ).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("rank_from"))
    columns = [*(c for c in pieces.columns if c != TURN), "sequence_id", "offset"]
    # full pieces: a sequence each; ids from the other end of the numbers
    full = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    return dealt.select(columns).unionByName(full.select(columns))


def _merged(places: list[tuple]) -> list[tuple]:
    """Join neighbouring places of one length that go on in step."""
    out: list[tuple] = []
    for p in sorted(places):
        q = out[-1] if out else None
        if q and q[0] == p[0] and q[2] == p[1] and q[4] == p[4] and q[3] + q[2] - q[1] == p[3]:
            out[-1] = (*q[:2], p[2], *q[3:])
        else:
            out.append(p)
    return out


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = END, ids: bool = False) -> DataFrame:
    """Pack all documents: a row per piece with its sequence and place there.

    ``ids`` adds the piece's token ids.  Null and empty texts are a single ``end``; null
    ids are packed as any other; repeated rows are packed each; an empty table gives none.
    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.  A text of any length is
    encoded whole.
    """
    pieces = pieces_of(docs, path, capacity, end, ids)
    return assign(stored(pieces.withColumn(TURN, F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int"))), capacity)
