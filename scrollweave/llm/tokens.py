"""Token ids of whole texts with the tokenizers library, each piece encoded once.

A byte-level BPE of this kind never merges across a space that a character
other than white space follows: its pattern starts a new word there, but not
before an added token (``<|endoftext|>``). Texts are cut at these places only,
so the ids of the pieces, one after the other, are the ids of the text. A
worker encodes each distinct piece once and looks the others up: by a hash, and
what is found counts only if its bytes are the same.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .bytewise import Text, same_ranges

END_ID = 2
#: Bytes that may follow a cut: printable ASCII, and lead bytes of U+00C0 to U+07FF, where no white space is.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
SOLID[0xC3:0xE0] = True
#: A worker forgets its pieces beyond so many ids, or four times so many bytes.
MOST_IDS = 8_000_000
#: Pieces in one call, and pieces in the dict before they join the arrays.
TOGETHER, NEWEST = 128, 1 << 17

#: Bytes of text that are encoded together: the more, the fewer pieces are looked up twice.
TEXT_BYTES = 2 << 20

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Names of added tokens are these tokens in a text, too.
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"\x20(?=" + b"|".join(map(re.escape, added)) + b")") if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        #: The narrowest type that holds all ids.
        self.kind = "<u2" if len(self.widths) <= 1 << 16 else "<u4"
        self.forget()

    def forget(self) -> None:
        """Known pieces: sorted keys with their numbers, and the newest in a dict; ids of number k are ids[begins[k]:begins[k + 1]], its bytes raw[places[k]:places[k + 1]]."""
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.newest: dict[int, int] = {}
        self.ids, self.begins, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int32), 0
        self.raw, self.places = np.zeros(1 << 17, np.uint8), np.zeros(1 << 12, np.int32)

    def _find(self, text: Text, keys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, -1 for those that aren't known; whether another piece has its key."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.numbers[at[hit]]
        rest = np.flatnonzero(out < 0)
        out[rest] = np.fromiter((self.newest.get(k, -1) for k in keys[rest].tolist()), np.int64, len(rest))
        found = np.flatnonzero(out >= 0)
        begin, size = self.places[out[found]], stops[found] - starts[found]
        like = self.places[out[found] + 1] - begin == size
        like &= same_ranges(text.at, starts[found], begin, np.where(like, size, 0), np.ndarray((len(self.raw) - 7,), "<u8", self.raw.data, strides=(1,)))
        other = np.zeros(len(keys), bool)
        other[found[~like]] = True
        out[found[~like]] = -1
        return out, other

    def _add(self, keys: np.ndarray, every: np.ndarray, sizes: np.ndarray, raw: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> None:
        """Give pieces numbers, in their order; those ``known`` can be found again."""
        begin, place, n = int(self.begins[self.count]), int(self.places[self.count]), self.count
        grown = lambda x, need: np.concatenate([x, np.zeros(max(len(x) // 4, need - len(x)), x.dtype)]) if need > len(x) else x
        self.ids, self.raw = grown(self.ids, begin + len(every)), grown(self.raw, place + len(raw) + 8)
        self.begins, self.places = grown(self.begins, n + len(keys) + 1), grown(self.places, n + len(keys) + 1)
        self.ids[begin : begin + len(every)] = every
        self.raw[place : place + len(raw)] = raw
        self.begins[n + 1 : n + len(keys) + 1] = begin + np.cumsum(sizes)
        self.places[n + 1 : n + len(keys) + 1] = place + np.cumsum(lengths)
        self.count += len(keys)
        self.newest.update(zip(keys[known].tolist(), (n + np.flatnonzero(known)).tolist(), strict=True))
        if len(self.newest) > NEWEST:
            both = np.concatenate([self.keys, np.fromiter(self.newest.keys(), np.uint64, len(self.newest))])
            numbers = np.concatenate([self.numbers, np.fromiter(self.newest.values(), np.int32, len(self.newest))])
            order = np.argsort(both, kind="stable")
            self.keys, self.numbers, self.newest = both[order], numbers[order], {}

    def _learn(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Encode pieces and remember them; the order in which they got their numbers.

        Pieces that begin as a cut does can stand one after the other in one
        call, ``TOGETHER`` of them; the bytes of their ids tell them apart.
        """
        sizes = stops - starts
        cut_like = (data[starts] == 0x20) & (sizes > 1) & SOLID[data[np.minimum(starts + 1, len(data) - 1)]]
        joint, alone = np.flatnonzero(cut_like), np.flatnonzero(~cut_like)
        bytes_of = lambda which: data[np.repeat(starts[which] - (np.cumsum(sizes[which]) - sizes[which]), sizes[which]) + np.arange(sizes[which].sum())]
        ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(joint):
            raw, ends = bytes_of(joint).tobytes(), np.cumsum(sizes[joint])
            edge = np.append(np.concatenate([[0], ends])[:-1:TOGETHER], ends[-1])
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids, group = np.concatenate(found), np.arange(len(joint)) // TOGETHER
            first = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            width = np.add.reduceat(self.widths[ids], first[:-1])
            # Where each id ends, as if all groups had as many bytes as their texts.
            reach = np.cumsum(self.widths[ids]) + np.repeat(edge[:-1] - (np.cumsum(width) - width), np.diff(first))
            last = np.searchsorted(reach, ends)
            fits = (width == np.diff(edge)) & (np.bincount(group, (last >= len(reach)) | (reach[np.minimum(last, len(reach) - 1)] != ends)) == 0)
            if not fits.all():  # bytes that aren't UTF-8
                ids = ids[np.repeat(fits, np.diff(first))]
                alone, joint, first, last = np.append(alone, joint[~fits[group]]), joint[fits[group]], first[:-1][group][fits[group]], last[fits[group]]
                # The first piece of a group begins where the group does.
                lead = np.append(True, group[fits[group]][1:] != group[fits[group]][:-1]) if len(joint) else np.zeros(0, bool)
                counts = last + 1 - np.where(lead, first, np.append(0, last[:-1] + 1)[: len(joint)])
            else:
                counts = np.diff(last, prepend=-1)
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[alone].tolist(), stops[alone].tolist(), strict=True)]
        more = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        order = np.append(joint, alone)
        self._add(keys[order], np.concatenate([ids, *more]), np.append(counts, [len(x) for x in more]).astype(np.int64), bytes_of(order), sizes[order], known[order])
        return order

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each document, and the offsets of the documents in them."""
        data, n = text.data, len(text.data)
        if max(self.begins[self.count], self.places[self.count] // 4) > MOST_IDS:
            self.forget()
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = (data[:-1] == 0x20) & SOLID[data[1:]] if n else False
        if self.added is not None and n:
            cut[[m.start() for m in self.added.finditer(data.tobytes())]] = False
        cut[text.offsets] = True
        # A space that ends a document is followed by another document, not by a word.
        ends_with_space = text.offsets[1:-1][data[text.offsets[1:-1] - 1] == 0x20] - 1 if n and text.n > 1 else np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[text.offsets] = True
        starts_here = edge[ends_with_space]
        cut[ends_with_space[~starts_here]] = False
        at = np.flatnonzero(cut)
        starts, stops = at[:-1], at[1:]
        keys = text.hashes(starts, stops)
        codes, first, alone = text.codes(starts, stops, keys)
        unique, begin, end = keys[first], starts[first], stops[first]
        slots, other = self._find(text, unique, begin, end)
        # Of pieces with one key, the first can be found again.
        other[alone:] = True
        new = np.flatnonzero(slots < 0)
        if len(new):
            order = self._learn(data, begin[new], end[new], unique[new], ~other[new])
            slots[new[order]] = np.arange(self.count - len(new), self.count)
        own, size = self.begins[slots][codes], (self.begins[slots + 1] - self.begins[slots])[codes]
        # Ids before each piece, with an end id after each document.
        doc = text.docs_of(starts)
        per_doc = np.bincount(doc, size, text.n).astype(np.int64) + 1
        offsets = np.concatenate([[0], np.cumsum(per_doc)])
        out = np.empty(offsets[-1], np.uint32)
        out[offsets[1:] - 1] = END_ID
        place = np.cumsum(size) - size + doc
        where = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[where] = self.ids[np.repeat(own - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return out, offsets
