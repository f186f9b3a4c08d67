"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Left to right, each prefix of a word has one last token: the token that ends there
and that no merge across its left edge would have taken apart. A boundary can only be
upset from the right by a chain of ever earlier merges, each of which takes the end of
the one before. The longest such chain, in symbols, is the merge list's sufficient
lookahead (``Merges.lookahead``): tokens that end that far back are final and leave at
once, so a word of any length needs memory for one window.

Texts are encoded in chunks that end at white space. The ids of a chunk go to the digest
and, as they are, to an incremental decoder; neither all ids nor the whole decoded text
are ever held.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import map_texts, per_process

#: Bytes of the table of known pieces, about; entries of the table of token pairs; characters of a chunk, about.
TABLE_BYTES, PAIRS, CHUNK = 96 << 20, 300_000, 1 << 16
#: Entries of each table of token edges; characters of the texts whose new words are sorted and encoded together, about.
EDGES, TOGETHER = 10_000, 1 << 20
WINDOW = 512
FOREVER = 1 << 60
#: White space as the tokenizer's patterns know it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(extra))
        extra += b not in shown
    return out


class Merges:
    """A compiled merge list. Symbols are byte values; the last of a word is 256 more, where the list has a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        named = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.text = [named.get(i, "") for i in range(max(named) + 1)]
        letters = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.symbol = [vocab[c] for c in letters] + ([vocab[c + self.end] for c in letters] if self.end else [])
        self.rank: dict[int, int] = {}
        # the parts of a token and the rank of the merge that makes it; a symbol has none
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        size = dict.fromkeys(self.symbol, 1)
        sound = set(self.symbol)
        reach: dict[int, int] = {}
        self.lookahead = 1
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in size:
                raise ValueError(f"two merges make {a + b!r}")
            size[z] = size[x] + size[y]
            if x in sound and y in sound and not self._crossed(x, y, r):
                sound.add(z)
            self.rank[x << 20 | y] = r
            chain = size[y] + max((reach.get(n, 0) for n, _ in self._edge(y, 1)), default=0)
            self.parts[z] = x, y, r
            reach[x] = max(reach.get(x, 0), chain)
            self.lookahead = max(self.lookahead, chain)
        self.longest = max(size.values())
        # tokens by their symbols from the last to the first: (node, symbol) to the next node
        self.step: dict[int, int] = {}
        token, parent = [-1], [(0, 0)]
        place = {s: k for k, s in enumerate(self.symbol)}
        for t in sound:
            node = 0
            for depth, s in enumerate(self._symbols_back(t), 1):
                above, node = node, self.step.setdefault(node << 9 | place[s], len(token))
                if node == len(token):
                    token.append(-1)
                    parent.append((above, depth))
            token[node] = t
        # tokens on the way to each node, the longest first: (size, token, shorter ones)
        self.on_way: list[tuple] = [()]
        for t, (above, depth) in zip(token[1:], parent[1:], strict=True):
            self.on_way.append((depth, t, self.on_way[above]) if t >= 0 else self.on_way[above])
        self._apart: dict[int, bool] = {}

    def _edge(self, t: int, side: int) -> tuple:
        """Tokens on the left (0) or right (1) edge of a token, itself first, each with the rank of the merge that takes it in; itself is never taken in."""
        edges = self.edges[side]
        got = edges.get(t)
        if got is None:
            out, rank = [], FOREVER
            inner: int | None = t
            while inner is not None:
                out.append((inner, rank))
                x, y, rank = self.parts.get(inner, (None, None, 0))
                inner = (x, y)[side]
            if len(edges) > EDGES:
                edges.clear()
            got = edges[t] = tuple(out)
        return got

    def _symbols_back(self, t: int) -> Iterator[int]:
        stack = [t]
        while stack:
            t = stack.pop()
            if t in self.parts:
                stack.extend(self.parts[t][:2])
            else:
                yield t

    def _crossed(self, x: int, y: int, before: int = FOREVER) -> bool:
        """Would a merge of lower rank than ``before`` join the end of x to the start of y? Equal ranks go left to right."""
        rank, left = self.rank.get, self._edge(y, 0)
        for a, taken_a in self._edge(x, 1):
            a <<= 20
            for b, taken_b in left:
                r = rank(a | b)
                if r is not None and r < before and r < taken_a and r <= taken_b:
                    return True
        return False

    def apart(self, x: int, y: int) -> bool:
        """Tokens x and y can stand side by side."""
        got = self._apart.get(x << 20 | y)
        if got is None:
            if len(self._apart) > PAIRS:
                self._apart.clear()
            got = self._apart[x << 20 | y] = not self._crossed(x, y)
        return got

    def symbols(self, data: Iterable[int]) -> Iterable[int]:
        """Bytes of one word as symbols, one byte late where words have an end mark."""
        if isinstance(data, bytes):
            return [*data[:-1], data[-1] + 256] if data and self.end else data
        return self._late(data) if self.end else data

    @staticmethod
    def _late(data: Iterable[int]) -> Iterator[int]:
        last = None
        for b in data:
            if last is not None:
                yield last
            last = b
        if last is not None:
            yield last + 256

    def _read(self, symbols: Iterable[int], tail: list[int], sizes: list[int], tokens: list[int], full: int) -> bool:
        """Take symbols in until they end or the tail holds ``full`` of them, and tell which. Position 0 of ``sizes`` and
        ``tokens`` is what has left; position k is the last token of the tail's first k symbols."""
        step, on_way, apart, n = self.step.get, self.on_way, self._apart.get, len(tail)
        for s in symbols:
            tail.append(s)
            n += 1
            # walk back from the end as far as any token reaches
            last, node, k = 0, step(s), n - 2
            while node is not None:
                last = node
                if k < 0:
                    break
                node = step(node << 9 | tail[k])
                k -= 1
            ways = on_way[last]
            while ways:
                size, t, ways = ways
                before = tokens[n - size]
                if before < 0 or apart(before << 20 | t) or ((before << 20 | t) not in self._apart and self.apart(before, t)):
                    sizes.append(size)
                    tokens.append(t)
                    break
            else:
                raise ValueError("a symbol has no token")
            if n >= full:
                return True
        return False

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one word that is held as a whole."""
        if len(data) > WINDOW:
            return list(self.encode_word(data))
        sizes, tokens = [0], [-1]
        self._read(self.symbols(data), [], sizes, tokens, FOREVER)
        return [tokens[stop] for stop in self._back(sizes)][::-1]

    def encode_sorted(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Every word with its ids. What has been read for the prefix that a word shares with the one before it is kept."""
        tail, sizes, tokens, last = [], [0], [-1], b""
        for w in words:
            if len(w) > WINDOW:
                yield w, self.encode(w)
                continue
            same, most = 0, min(len(w), len(last)) - 1  # the last symbol of a word is another one
            while same < most and w[same] == last[same]:
                same += 1
            del tail[same:], sizes[same + 1 :], tokens[same + 1 :]
            self._read(self.symbols(w)[same:], tail, sizes, tokens, FOREVER)
            last = w
            yield w, [tokens[stop] for stop in self._back(sizes)][::-1]

    def encode_word(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one word, each as soon as it is stable."""
        symbols, full = iter(self.symbols(data)), WINDOW + self.lookahead + self.longest
        tail, sizes, tokens = [], [0], [-1]
        while self._read(symbols, tail, sizes, tokens, full):
            final, cut = len(tail) - self.lookahead, 0
            for stop in reversed(self._back(sizes)):
                if stop > final:
                    break
                yield tokens[stop]
                cut = stop
            tail[:cut], sizes[: cut + 1], tokens[: cut + 1] = [], [0], [tokens[cut]]
        yield from [tokens[stop] for stop in self._back(sizes)][::-1]

    @staticmethod
    def _back(sizes: list[int]) -> list[int]:
        """Ends of the tokens of the whole tail, from the last."""
        out, n = [], len(sizes) - 1
        while n:
            out.append(n)
            n -= sizes[n]
        return out


class Decoder:
    """Ids to text, as they come. Plain: bytes wait until they form a character, and a word end becomes a space.
    Otherwise the rule of a tokenizer without a decoder: the tokens' own spelling, a space between two of them."""

    def __init__(self, merges: Merges, plain: bool = False):
        self.merges, self.plain, self.begun = merges, plain, False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.special = set(merges.special.values())

    def feed(self, ids: Iterable[int]) -> str:
        text = self.merges.text
        if not self.plain:
            made = " ".join([text[i] for i in ids])
            made, self.begun = (" " + made if self.begun and made else made), self.begun or bool(made)
            return made
        out, end = [], self.merges.end
        for i in ids:
            t = text[i]
            if i in self.special:
                out.append(self.bytes.decode(b"", True) + t)
                self.bytes.reset()
                continue
            ended = bool(end) and t.endswith(end)
            body = t[: -len(end)] if ended else t
            out.append(self.bytes.decode(bytes(self.merges.bytes_of[c] for c in body), ended) + (" " if ended else ""))
        return "".join(out)

    def close(self) -> str:
        return self.bytes.decode(b"", True) if self.plain else ""


class Known:
    """Ids of pieces in about ``limit`` bytes and two generations: when the young one is full the old one goes, and what is met again stays."""

    def __init__(self, limit: int, make: Callable[[str], bytes]):
        self.half, self.make, self.young, self.old, self.size = limit // 2, make, {}, {}, 0

    def __getitem__(self, key: str) -> bytes:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            self.put(key, self.make(key) if got is None else got)
            got = self.young[key]
        return got

    def put(self, key: str, value: bytes) -> None:
        self.size += 180 + 2 * len(key) + len(value)
        self.young[key] = value

    def turn(self) -> None:
        if self.size > self.half:
            self.old, self.young, self.size = self.young, {}, 0


class WordEncoder:
    """Texts to ids through the transducer, with a table of pieces and words already seen that is bounded in bytes."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        import regex

        self.merges = Merges(path)
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        self.starts = {m[0] for m in self.merges.special}
        self.known = Known(table_bytes, self.piece)

    def words(self, piece: str) -> list[str | int]:
        """Words, and ids of special tokens, of a piece without plain white space."""
        if piece.isascii() and piece.isalpha():
            return [piece.lower()]
        out: list[str | int] = []
        cut = self.marks.split(piece) if any(c in piece for c in self.starts) else [piece]
        for k, part in enumerate(cut):
            if k % 2:
                out.append(self.merges.special[part])
                continue
            part = part if part.isascii() else unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            out += [part] if part.isalpha() else self.pattern.findall(part)
        return out

    def piece(self, piece: str) -> bytes:
        """Little-endian ids of a piece without plain white space."""
        out = []
        for w in self.words(piece):
            if w.__class__ is int:
                out.append(w.to_bytes(4, "little"))
            elif w != piece and self.own_piece(w):
                out.append(self.known[w])  # such a word is a piece too, and most words come in many pieces
            else:
                out.append(array("I", self.merges.encode(w.encode())).tobytes())
        return b"".join(out)

    @staticmethod
    def own_piece(word: str) -> bool:
        """The word, taken for a piece, is that word again."""
        return word.isascii() or (unicodedata.is_normalized("NFC", word) and word.lower() == word)

    @staticmethod
    def cut(text: str) -> list[str]:
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        return text.split(" ")

    def learn(self, texts: list[str]) -> None:
        """Put the words that come new in some texts into the table, in one sorted run."""
        known = self.known
        known.turn()
        new = set().union(*map(self.cut, texts)).difference(known.young, known.old)
        words = {p for p in new if p.isascii() and p.isalpha() and p.islower()}
        words.update(w for p in new.difference(words) for w in self.words(p) if w.__class__ is str and self.own_piece(w))
        words.difference_update(known.young, known.old)
        for w, ids in self.merges.encode_sorted(sorted(w.encode() for w in words)):
            known.put(w.decode(), array("I", ids).tobytes())

    def chunk(self, text: str) -> bytes:
        self.known.turn()
        return b"".join(map(self.known.__getitem__, self.cut(text)))

    def stream(self, text: str) -> Iterator[array]:
        """Ids of a text, chunk by chunk; a chunk ends at plain white space, where no token can cross."""
        at = 0
        while at < len(text):
            stop = at + CHUNK
            while stop < len(text) and text[stop] not in " \n\t\r\x0b\x0c":
                stop += 1
            ids = array("I")
            ids.frombytes(self.chunk(text[at:stop]))
            yield ids
            at = stop


def encoder(path: str) -> WordEncoder:
    return per_process(f"bpe:{path}", lambda: WordEncoder(path))


def learned(own: WordEncoder, texts: list[str | None]) -> Iterator[str]:
    """The texts, null as empty; before each run of about ``TOGETHER`` characters its new words are learned."""
    run, size = [], 0
    for k, t in enumerate(texts, 1):
        run.append(t or "")
        size += len(run[-1])
        if size >= TOGETHER or k == len(texts):
            own.learn([t for t in run if len(t) < TOGETHER])  # a longer text is learned as it is read
            yield from run
            run, size = [], 0


def digest_batch(texts: list[str | None], path: str) -> dict[str, list]:
    own = encoder(path)
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for t in learned(own, texts):
        n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(own.merges)
        for ids in own.stream(t):
            n += len(ids)
            of_ids.update(ids)
            of_text.update(decoder.feed(ids).encode())
        out["n_tokens"].append(n)
        out["ids_sha256"].append(of_ids.hexdigest())
        out["decoded_sha256"].append(of_text.hexdigest())
    return out


def encode_batch(texts: list[str | None], path: str) -> dict[str, list]:
    own = encoder(path)
    out: dict[str, list] = {"ids": [], "tokens": [], "plain": []}
    for t in learned(own, texts):
        numbers = [i for ids in own.stream(t) for i in ids]
        plain = Decoder(own.merges, plain=True)
        out["ids"].append(numbers)
        out["tokens"].append(Decoder(own.merges).feed(numbers))
        out["plain"].append(plain.feed(numbers) + plain.close())
    return out


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``ids``, ``tokens`` (the tokens' own spelling, space-joined) and ``plain`` (the text they stand for).

    Null and empty texts have no ids. Null ids stay null, repeated rows give
    repeated results, an empty table an empty result; other columns are ignored.
    """
    schema = "ids array<bigint>, tokens string, plain string"
    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t")), ["doc_id"], "__t", schema, lambda texts: encode_batch(texts, path), f"bpe:{path}")


def digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` beside ``n_tokens`` and the SHA-256 of ids (little-endian 32 bits) and of the decoded text; same rules as ``encode_decode``."""
    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs.select(*keep, F.col(text).alias("__t")), keep, "__t", schema, lambda texts: digest_batch(texts, path), f"bpe:{path}")
