"""Byte-level BPE as a streaming transducer with bounded lookahead, and incremental decoding.

In merge-list BPE the encoding of a text is the one token sequence in which every neighbouring pair is
stable, that is, encodes to itself.  So the last token of the encoding of each prefix follows from
those of shorter prefixes, one byte at a time.  Any token still to come begins within the last
`lookahead` bytes read, `lookahead` being the length of the longest token that the merge list can
make; where the encodings of all prefixes in that window share a beginning, that beginning can change
no more and is emitted.  Only the window and the unshared end are kept.

Whether a pair is stable is read off the merge list.  Merges happen in rank order, so the right edge of
the left token is at each time one token of its right spine (itself, its right half, the right half of
that, and so on), the left edge of the right token one of its left spine, and each is there until the
rank at which the next larger one is made.  The pair is stable if no two edges that stand side by side
when the rank of their merge comes have a merge.

Texts come in pieces and are cut first where the tokenizer cuts them: at special tokens, then into runs
of letters, numbers, other characters and blanks.  The cut needs a lookahead of two characters.  Parts
between blanks recur, and runs recur in other parts, so the ids of the last ones met are kept, in two generations of bounded size; a
part that grows beyond HOLD characters is encoded while it is still open.

Defined cases: null and empty texts have no tokens; texts of any length are encoded whole; repeated rows
are encoded alike; an empty table gives an empty result; null ids are carried; other columns are ignored.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: White space as the tokenizer's patterns see it.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A part: blanks and what follows them up to the next blank, or up to the first sign of SIGNS if a letter stands before it.  The
#: tokenizer's runs end at both places (a run with a letter ends with a letter), so no token crosses the ends of a part.
SIGNS, LETTERS = ".,;:!?", "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PART = re.compile(f"[{BLANK}]*(?:[^{BLANK}{SIGNS}]+(?:(?<=[{LETTERS}])(?=[{SIGNS}])|[^{BLANK}]*)|[{SIGNS}][^{BLANK}]*)|[{BLANK}]+")
#: So many parts, runs, pairs of tokens and beginnings of runs are remembered by each worker before it starts anew.
CACHE, RUNS, PAIRS, HEADS = 160_000, 250_000, 150_000, 80_000
#: Runs that begin with the same bytes share the work for so many of them, or for the lesser number.
LONG_HEAD, SHORT_HEAD = 7, 4
#: A part of more characters than this is encoded while it is still open.
HOLD = 4096
#: Texts are handed to the encoder in pieces of so many characters.
PIECE = 1 << 16
SHIFT, NEVER = 20, 1 << 60


def tokenizer_file(name: str = TOKENIZER) -> str:
    """A path is taken as it is; a bare name is one of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeList:
    """Vocabulary and merges of a tokenizer file, over bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        as_bytes = lambda s: bytes(byte_of[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in vocab.items() if s not in self.specials}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.specials.items():
            self.bytes[i] = s.encode()
        self.sizes = list(map(len, self.bytes))
        #: Rank of the merge of a pair, under left << SHIFT | right.
        self.ranks: dict[int, int] = {}
        #: For each token the edges that its right (left) end shows to a neighbour: token (shifted for the
        #: right end) and the rank at which the next larger one replaces it.
        self.right: list[tuple] = [((i << SHIFT, NEVER),) for i in range(size)]
        self.left: list[tuple] = [((i, NEVER),) for i in range(size)]
        made = [-1] * size  # rank at which a token is made from its own bytes
        #: Tokens that encode to themselves, by their bytes; the others occur in no encoding.
        self.whole = {bytes([b]): self.ids[bytes([b])] for b in range(256)}
        merges = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            merges.append((self.ids[left], self.ids[right], self.ids[left + right]))
            self.ranks[merges[-1][0] << SHIFT | merges[-1][1]] = rank
        for rank, (left, right, token) in enumerate(merges):
            if made[left] >= rank or made[right] >= rank:
                raise ValueError("a merge comes before those of its halves")
            both = self.bytes[left] in self.whole and self.bytes[right] in self.whole
            if both and self.bytes[token] not in self.whole and self._apart(left, right, rank):
                made[token] = rank
                self.whole[self.bytes[token]] = token
                self.right[token] += ((self.right[right][0][0], rank), *self.right[right][1:])
                self.left[token] += ((left, rank), *self.left[left][1:])
        #: The last pairs asked for, and whether they are stable.
        self.pairs: dict[int, bool] = {}
        #: Last tokens of the prefixes of the beginnings last met.
        self.heads: dict[bytes, list[int]] = {}
        #: Bytes within which every later token begins.
        self.lookahead = max(map(len, self.ids))
        #: Tokens by their bytes from the last to the first: byte -> (the token that begins there or None, the same table for one byte more).
        self.ending: dict = {}
        for b, i in self.whole.items():
            node = self.ending
            for byte in reversed(b[1:]):
                node = node.setdefault(byte, (None, {}))[1]
            node[b[0]] = i, node[b[0]][1] if b[0] in node else {}
        #: The first token of a run has this neighbour, with which all tokens are stable.
        self.start = size
        self.right.append(())

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank below `before` joins the edges of two neighbours."""
        rank_of = self.ranks.get
        for x, x_end in self.right[a]:
            for y, y_end in self.left[b]:
                rank = rank_of(x | y)
                # Equal ranks are equal pairs, and of these the leftmost is merged first.
                if rank is not None and rank < before and rank < x_end and rank <= y_end:
                    return False
        return True

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        found = self._apart(a, b, NEVER)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << SHIFT | b] = found
        return found


class Transducer:
    """Bytes of one run in, ids out as soon as no later byte can change them."""

    def __init__(self, table: MergeList) -> None:
        self.table = table
        self.data = bytearray()  # bytes not yet emitted
        self.last = [table.start]  # last token of each prefix of data; before it the token emitted last

    def push(self, more: bytes) -> list[int]:
        most, out = 4 * self.table.lookahead, []
        for at in range(0, len(more), most):
            self._read(more[at : at + most])
            if len(self.data) >= most:
                out += self._settle()
        return out

    def _read(self, more: bytes) -> None:
        if len(self.last) == 1 and self.last[0] == self.table.start and len(more) > SHORT_HEAD:
            # A run begins: what is known of another run with the same beginning holds for it.
            heads, size = self.table.heads, LONG_HEAD if len(more) > LONG_HEAD else SHORT_HEAD
            known = heads.get(more[:size])
            if known is None:
                if size > SHORT_HEAD and (shorter := heads.get(more[:SHORT_HEAD])):
                    self.last[:] = shorter
                    self.data += more[:SHORT_HEAD]
                elif size > SHORT_HEAD:
                    self._step(more[:SHORT_HEAD])
                    heads[more[:SHORT_HEAD]] = self.last.copy()
                self._step(more[len(self.data) : size])
                if len(heads) >= HEADS:
                    heads.clear()
                heads[more[:size]] = self.last.copy()
            else:
                self.last[:] = known
                self.data += more[:size]
            more = more[size:]
        self._step(more)

    def _step(self, more: bytes) -> None:
        data, last = self.data, self.last
        ending, stable, known = self.table.ending, self.table.stable, self.table.pairs.get
        begun = len(data)
        data += more
        for at in range(begun, len(data)):
            found, table = -2, ending  # -2: no encoding ends here beside the tokens already emitted
            while at >= 0 and (node := table.get(data[at])):
                token, table = node
                if token is not None and (previous := last[at]) >= 0:
                    yes = known(previous << SHIFT | token)
                    if yes or (yes is None and stable(previous, token)):
                        found = token
                        break
                at -= 1
            last.append(found)

    def _path(self, end: int) -> list[int]:
        path, last, sizes = [], self.last, self.table.sizes
        while end > 0:
            token = last[end]
            path.append(token)
            end -= sizes[token]
        path.reverse()
        return path

    def _settle(self) -> list[int]:
        """Emit what the encodings of all prefixes in the window share."""
        end = len(self.data)
        live = {i for i in range(end - self.table.lookahead + 1, end + 1) if self.last[i] >= 0}
        while len(live) > 1:
            furthest = max(live)
            live.remove(furthest)
            live.add(furthest - self.table.sizes[self.last[furthest]])
        shared = live.pop()
        if not shared:
            return []
        out = self._path(shared)
        del self.data[:shared]
        self.last = [out[-1], *self.last[shared + 1 :]]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.data))
        self.data.clear()
        self.last = [self.table.start]
        return out


class Spelling:
    """A byte string for every id; spells sequences of ids by one gather."""

    def __init__(self, words: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.array(list(map(len, words)))
        self.begin = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.arange(size.sum()) + np.repeat(self.begin[ids] - end + size, size)].tobytes()


class Encoder:
    def __init__(self, path: str, share: float = 1) -> None:
        import regex

        self.share = share
        self.table = MergeList(path)
        self.run = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
        self.kinds = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", rf"[^{BLANK}\p{{L}}\p{{N}}]+", f"[{BLANK}]+")]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.table.specials, key=len, reverse=True))) + ")") if self.table.specials else None
        self.decimal = Spelling([b"%d," % i for i in range(len(self.table.bytes))])
        self.decoded = Spelling(self.table.bytes)
        self.machine = Transducer(self.table)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Packed ids of the runs last met: one run recurs in parts with other signs beside it.
        self.young_runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def _run_ids(self, run: str) -> bytes:
        found = self.young_runs.get(run)
        if found is None:
            found = self.old_runs.get(run)
            if found is None:
                data = run.encode("utf-8", "surrogatepass")
                whole = self.table.whole.get(data)
                found = _packed([whole] if whole is not None else self.machine.push(data) + self.machine.finish())
            if len(run) < 64:
                if len(self.young_runs) >= RUNS * self.share:
                    self.old_runs, self.young_runs = self.young_runs, {}
                self.young_runs[run] = found
        return found

    def part(self, part: str) -> bytes:
        """Ids of a part as little-endian uint32; the younger generation remembers it."""
        found = self.old.get(part)
        if found is None:
            found = b"".join(map(self._run_ids, self.run.findall(part)))
        if len(part) < 64:
            if len(self.young) >= CACHE * self.share:
                self.old, self.young = self.young, {}
            self.young[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return self.ids(_pieces(text))

    def ids(self, pieces: Iterable[str]) -> list[int]:
        return np.frombuffer(b"".join(self.stream(pieces)), "<u4").tolist()

    def stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids, as little-endian uint32, of a text that comes in pieces; in constant memory whatever its length and its parts'."""
        hold = max([HOLD, *(len(s) for s in self.table.specials)])
        buffer, opened, kind, closed = "", None, None, False
        source = iter(pieces)
        while True:
            if not closed:
                piece = next(source, None)
                closed = piece is None
                buffer += piece or ""
            if len(buffer) < 2 * hold and not closed:
                continue
            # Up to the last character that could begin an unfinished special token everything can be cut.
            safe = len(buffer) if closed else self._safe_end(buffer)
            at = 0
            while at < safe:
                special = self.special.search(buffer, at, safe) if self.special else None
                until = special.start() if special else safe
                if opened:
                    m = kind.match(buffer, at, until)
                    end = m.end() if m else at
                    # The last blank of a run goes with what follows it; so one character stays back.
                    more = end == safe and not closed
                    blank_before_text = kind is self.kinds[3] and end < until
                    yield _packed(opened.push(buffer[at : end - 1 if more or blank_before_text else end].encode("utf-8", "surrogatepass")))
                    at = end - 1 if more or blank_before_text else end
                    if more:
                        break
                    yield _packed(opened.finish())
                    opened = None
                    continue
                if special and special.start() == at:
                    yield _packed([self.table.specials[special[0]]])
                    at = special.end()
                    continue
                parts = PART.findall(buffer, at, until)
                whole = closed or special is not None
                if not whole:
                    at = until - len(parts.pop())  # the last part is still open
                known, part = self.young.get, self.part
                yield b"".join([known(p) or part(p) for p in parts])
                if whole:
                    at = until
                    continue
                if until - at <= hold:
                    break
                # A long open part: its runs one by one, and one that fills the rest as it comes.
                m = self.run.match(buffer, at, until)
                while m.end() < until and m.start() + 3 <= until:
                    yield self._run_ids(m[0])
                    at = m.end()
                    m = self.run.match(buffer, at, until)
                if m.end() == until and m.end() - at > hold:
                    opened = Transducer(self.table)
                    kind = next(k for k in self.kinds if k.match(m[0][-1]))
                    yield _packed(opened.push(buffer[at : until - 1].encode("utf-8", "surrogatepass")))
                    at = until - 1
                break
            buffer = buffer[at:]
            if closed:
                if opened:
                    yield _packed(opened.finish())
                return

    def _safe_end(self, buffer: str) -> int:
        end = len(buffer)
        for s in self.table.specials:
            for n in range(min(len(s) - 1, len(buffer)), 0, -1):
                if buffer.endswith(s[:n]):
                    end = min(end, len(buffer) - n)
                    break
        return end


class Decoder:
    """Ids in, text out: whole characters as soon as their bytes are there, U+FFFD for bytes that form none."""

    def __init__(self, table: MergeList) -> None:
        self.bytes = table.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.push_bytes(b"".join(map(self.bytes.__getitem__, ids)))

    def push_bytes(self, data: bytes) -> str:
        """The same for ids whose bytes are looked up already."""
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(2)
def encoder(path: str, share: float = 1) -> Encoder:
    found = Encoder(path, share)
    gc.freeze()  # the tables stay for the worker's life; no collection needs to walk them
    return found


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _pieces(text: str) -> Iterator[str]:
    return (text[at : at + PIECE] for at in range(0, len(text), PIECE)) if len(text) > PIECE else iter((text,))


def digests(text: str | None, codec: Encoder, ids: list[bytes] | None = None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of their decimal list, SHA-256 of the decoded text, all as the ids come.

    The ids themselves are added to `ids`, if given, as little-endian uint32.
    """
    listed, decoded, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(codec.table), 0
    for packed in codec.stream(_pieces(text or "")):
        if packed:
            some = np.frombuffer(packed, "<u4")
            listed.update((b"," if n else b"") + codec.decimal.of(some)[:-1])
            decoded.update(decoder.push_bytes(codec.decoded.of(some)).encode("utf-8", "surrogatepass"))
            n += len(some)
            if ids is not None:
                ids.append(packed)
    decoded.update(decoder.finish().encode())
    return n, listed.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, with_ids: bool = False, share: float = 1) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, and the ids as an array if wanted.

    share: of CACHE and RUNS, what a worker remembers; less takes less memory and more time, and gives the same ids.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer_file(tokenizer), share)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                ids: list[bytes] | None = [] if with_ids else None
                rows = [digests(t, codec, ids) for t in some.column(1).to_pylist()]
                columns = [some.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))]
                if with_ids:
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    offsets = np.cumsum([0] + [r[0] for r in rows]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(code, kind)
