"""Token ids and counts from the files of public tokenizers."""

from __future__ import annotations

import hashlib
import json
import os
import re

from .common import worker_state

DEFAULT = "byte_bpe_50k.json"
#: Words of one generation of a worker's memory; what is used again moves to the next, and the one before is dropped.
MEMO_WORDS = 400_000
#: Words of up to so many bytes are told apart by two numbers, which hold these bytes and how many there are.
SHORT = 15
#: Characters of text that are worked on at a time.
CHARS = 2_000_000


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Names the version of a tokenizer: the SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Memo:
    """Ids of words, both as bytes: of those of the last generation, and of the new ones. most: words of a generation, if not MEMO_WORDS."""

    def __init__(self, most: int | None = None):
        self.most = most
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def get(self, words: list[bytes], learn) -> list[bytes]:
        """learn(words) gives the ids of those that are in neither generation."""
        found = list(map(self.now.get, words))
        lost = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(lost, map(self.before.get, [words[i] for i in lost])):
            found[i] = x
        missing = [i for i in lost if found[i] is None]
        if missing:
            for i, x in zip(missing, learn([words[i] for i in missing])):
                found[i] = x
        self.now.update((words[i], found[i]) for i in lost)
        if len(self.now) > (self.most or MEMO_WORDS):
            self.before, self.now = self.now, {}
        return found


def spans(start, number):
    """The places start[i] to start[i] + number[i] - 1 of all i, one after another."""
    import numpy as np

    out = np.repeat(start - np.cumsum(number) + number, number)
    out += np.arange(len(out))
    return out


class Words:
    """Ids of short words. A row: the word (two numbers), where its ids start in flat, and how many there are.

    A row stands at the place that its word's numbers give, or the next free one; half of the places stay free.
    """

    def __init__(self, places: int = 1 << 10):
        import numpy as np

        self.rows, self.count = np.zeros((places, 4), np.uint64), 0
        self.flat, self.used = np.zeros(1 << 10, np.uint32), 0

    def places(self, a, b):
        import numpy as np

        h = a * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += b
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h >>= np.uint64(65 - len(self.rows).bit_length())
        return h.astype(np.int64)

    def find(self, a, b):
        """For each word: whether it is known, the start of its ids, their number (0 if not known)."""
        import numpy as np

        at, rows = self.places(a, b), self.rows.view("V32").reshape(-1)
        got = rows.take(at, mode="clip").view(np.uint64).reshape(-1, 4)
        left = np.flatnonzero((got[:, 0] != a) | (got[:, 1] != b))
        left = left[got[left, 1] != 0]
        while len(left):
            at[left] = (at[left] + 1) % len(rows)
            new = rows.take(at[left], mode="clip").view(np.uint64).reshape(-1, 4)
            got[left] = new
            left = left[(new[:, 1] != 0) & ((new[:, 0] != a[left]) | (new[:, 1] != b[left]))]
        return got[:, 1] != 0, got[:, 2].astype(np.int64), got[:, 3].astype(np.int64)

    def room(self, ids: int) -> None:
        import numpy as np

        if self.used + ids > len(self.flat):
            more = np.zeros(max(self.used + ids, len(self.flat) * 3 // 2), np.uint32)
            more[: self.used] = self.flat[: self.used]
            self.flat = more

    def add(self, a, b, ids, number):
        """Takes in words that are not known, each once; returns the starts of their ids."""
        import numpy as np

        self.room(len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(number) - number
        self.used += len(ids)
        new = np.stack([a, b, start.astype(np.uint64), number.astype(np.uint64)], 1)
        self.count += len(new)
        if 2 * self.count > len(self.rows):
            new = np.concatenate([self.rows[self.rows[:, 1] != 0], new])
            self.rows = np.zeros((1 << (2 * self.count).bit_length(), 4), np.uint64)
        at, rows, new = self.places(new[:, 0], new[:, 1]), self.rows.view("V32").reshape(-1), new.view("V32").reshape(-1)
        while len(at):
            free = self.rows[at, 1] == 0
            rows[at[free]] = new[free]
            # Of several words for one place the last one has it.
            there, own = rows.take(at).view(np.uint64).reshape(-1, 4), new.view(np.uint64).reshape(-1, 4)
            left = (there[:, 0] != own[:, 0]) | (there[:, 1] != own[:, 1])
            at, new = (at[left] + 1) % len(rows), new[left]
        return start


#: Classes of characters, and what ends a text: a character that the library would be asked about.
SPACE, LETTER, DIGIT, OTHER, END = 1, 2, 3, 4, 5
END_MARK = "\x1c"
#: Endings that the pattern takes together with an apostrophe before them.
ONE, TWO = "stmd", ("re", "ve", "ll")


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers.

    The library (tokenizers for .json, sentencepiece for .model) makes all ids. For byte-level BPE the words of its own
    pattern are encoded once each and remembered, as no merge crosses them. That holds for texts of Latin letters and
    common punctuation, for which the pattern is written out; texts with other characters, on which versions of Unicode
    may differ, or with special strings go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo, self.kinds = Memo(), None
        self.now, self.before = Words(), Words()
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.sp, self.tok = None, Tokenizer.from_file(path)
        if hasattr(self.tok.model, "_resize_cache"):
            # The library's own memory of words is smaller than the one here, and takes time when it is full.
            model = self.tok.model
            model._resize_cache(0)
            self.tok.model = model
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            import numpy as np
            import regex

            known = [*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028), 0x20AC]
            kinds = np.zeros(max(known) + 2, np.uint8)  # the last one stands for all beyond
            for c in known:
                kinds[c] = next(k for k, p in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (OTHER, ".")) if regex.match(p, chr(c), regex.S))
            kinds[ord(END_MARK)] = END
            self.kinds = kinds
            self.special = [x["content"] for x in spec.get("added_tokens", [])]
            self.odd = re.compile(f"[^{''.join(re.escape(chr(c)) for c in known)}]").search
            # The characters that stand for bytes in the vocabulary, in which words go to the library's model.
            self.signs = np.arange(256, dtype="<u4")
            others = [b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b)]
            self.signs[others] = 256 + np.arange(len(others))
            self.model = self.tok.model

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        if self.sp:
            return [np.array(x, np.uint32).tobytes() for x in self.sp.encode(texts, num_threads=1)]
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, missing: list[bytes]) -> list[bytes]:
        import numpy as np

        text = self.signs[np.frombuffer(b"".join(missing), np.uint8)].tobytes().decode("utf-32-le")
        cuts = np.cumsum([0, *map(len, missing)]).tolist()
        made = list(map(self.model.tokenize, map(text.__getitem__, map(slice, cuts[:-1], cuts[1:]))))
        raw = np.array([t.id for x in made for t in x], np.uint32).tobytes()
        cuts = (np.cumsum([0, *map(len, made)]) * 4).tolist()
        return list(map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:])))

    def short(self, a, b, names):
        """Start and number of the ids, in now.flat, of words given by their numbers. names(places): the bytes of some."""
        import numpy as np

        known, start, number = self.now.find(a, b)
        lost = np.flatnonzero(~known)
        if len(lost):
            lost = lost[np.lexsort((a[lost], b[lost]))]
            first = np.ones(len(lost), bool)
            first[1:] = (a[lost[1:]] != a[lost[:-1]]) | (b[lost[1:]] != b[lost[:-1]])
            each = lost[first]
            old, at, n = self.before.find(a[each], b[each])
            ids = self.before.flat.take(spans(at[old], n[old]))
            learned = self.learn(names(each[~old]))
            each = np.concatenate([each[old], each[~old]])
            n = np.concatenate([n[old], np.fromiter(map(len, learned), np.int64, len(learned)) // 4])
            at = self.now.add(a[each], b[each], np.concatenate([ids, np.frombuffer(b"".join(learned), np.uint32)]), n)
            # From the order of each back to that of the lost.
            place = np.empty(len(each), np.int64)
            place[np.concatenate([np.flatnonzero(old), np.flatnonzero(~old)])] = np.arange(len(each))
            place = place[np.cumsum(first) - 1]
            start[lost], number[lost] = at[place], n[place]
        return start, number

    def parts(self, texts: list[str]):
        """For some texts at a time: their places in the list, then the ids of all their words (flat, each word's start and
        number), and where each text ends among them. Other texts: places and ids. To be used before the next ones."""
        plain = [] if self.kinds is None else [i for i, t in enumerate(texts) if not any(s in t for s in self.special)]
        start, chars = 0, 0
        odd = [] if len(plain) == len(texts) else sorted({*range(len(texts))}.difference(plain))
        for k, i in enumerate(plain):
            chars += len(texts[i]) + 1
            if chars < CHARS and k < len(plain) - 1:
                continue
            some, start, chars = plain[start : k + 1], k + 1, 0
            found = self.words([texts[j] for j in some])
            if found is None:
                odd += [j for j in some if self.odd(texts[j])]
                some = [j for j in some if not self.odd(texts[j])]
                found = self.words([texts[j] for j in some]) if some else None
            if some:
                yield some, None, found
        if odd:
            yield odd, self.whole([texts[i] for i in odd]), None

    def words(self, texts: list[str]):
        """As parts() gives them; None if a text has a character that is not known."""
        import numpy as np

        text = END_MARK.join(texts) + END_MARK
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds.take(at, mode="clip")
        if not kind.min() or text.count(END_MARK) > len(texts):
            return None
        # A word begins where the class changes; a space goes with what follows it, so that this does not begin anew.
        first = np.empty(len(kind), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        space, end = kind == SPACE, kind == END
        first |= end
        blank = at == 32
        solid = ~(space | end)
        first[1:] &= ~(blank[:-1] & solid[1:])
        # The last of several white-space characters before a word stands alone, or goes with the word if it is a space.
        first[1:-1] |= space[1:-1] & space[:-2] & solid[2:]
        # An apostrophe that begins a word takes some endings, and what letters follow begin anew.
        mark = np.flatnonzero(at == 39)
        mark = mark[first[mark]]
        if len(mark):
            one, two = at[mark + 1], at[np.minimum(mark + 2, len(at) - 1)]
            size = np.isin(one, [ord(c) for c in ONE]).astype(np.int64)
            for a, b in TWO:
                size[(one == ord(a)) & (two == ord(b))] = 2
            mark, size = mark[size > 0], size[size > 0]
            first[mark + 1] = False
            past = mark + size + 1
            first[past[kind[past] == LETTER]] = True
        starts = first_at = np.flatnonzero(first)
        ends = np.flatnonzero(end[starts])
        raw = text.encode()
        if len(raw) > len(text):
            more = (at >= 0x80).view(np.int8) + (at >= 0x800).view(np.int8)
            # The bytes beyond one a character, up to each word's first character less its own.
            starts = starts + np.cumsum(more, dtype=np.int32).take(starts) - more.take(starts)
        size = np.diff(starts, append=len(raw))
        # A word's bytes, from the eights that they lie in.
        eights = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8")
        at, by = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        one, two, three = eights.take(at), eights.take(at + 1), eights.take(at + 2)
        up = np.uint64(64) - by
        few = np.minimum(size, SHORT + 1)
        fill = np.array([(1 << 8 * k) - 1 for k in range(SHORT + 2)], object)
        a = (one >> by | two << up) & (fill & (1 << 64) - 1).astype(np.uint64)[few]
        b = (two >> by | three << up) & (fill >> 64 & (1 << 56) - 1).astype(np.uint64)[few]
        b |= size.astype(np.uint64) << np.uint64(56)
        names = lambda i: list(map(raw.__getitem__, map(slice, starts[i].tolist(), (starts[i] + size[i]).tolist())))
        start, number = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        some = np.flatnonzero((size <= SHORT) & ~end[first_at])
        start[some], number[some] = self.short(a[some], b[some], lambda i: names(some[i]))
        long = np.flatnonzero(size > SHORT)
        if len(long):
            words = names(long)
            each = dict.fromkeys(words)
            found = self.memo.get(list(each), self.learn)
            n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            # Behind the ids that are kept, for as long as these texts need them.
            now, ids = self.now, np.frombuffer(b"".join(found), np.uint32)
            now.room(len(ids))
            now.flat[now.used : now.used + len(ids)] = ids
            each.update(zip(each, range(len(each))))
            place = np.fromiter(map(each.__getitem__, words), np.int64, len(words))
            start[long], number[long] = (now.used + np.cumsum(n) - n)[place], n[place]
        flat = self.now.flat
        if self.now.count > (self.memo.most or MEMO_WORDS):
            self.before, self.now = self.now, Words()
        return flat, start, number, ends

    def ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        out: list = [None] * len(texts)
        for places, direct, words in self.parts(texts):
            if words:
                flat, start, number, ends = words
                raw = flat.take(spans(start, number), mode="clip").tobytes()
                cuts = (np.cumsum(number)[ends] * 4).tolist()
                direct = map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))
            for i, x in zip(places, direct):
                out[i] = x
        return out

    def counts(self, texts: list[str]) -> list[int]:
        import numpy as np

        out = [0] * len(texts)
        for places, direct, words in self.parts(texts):
            if words:
                _, _, number, ends = words
                counts = np.diff(np.cumsum(number)[ends], prepend=0).tolist()
            else:
                counts = [len(x) // 4 for x in direct]
            for i, n in zip(places, counts):
                out[i] = n
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    kept = worker_state().setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
