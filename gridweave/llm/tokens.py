"""Token ids of whole texts, by the vocabulary files of public tokenizers.

Both kinds of tokenizer treat what stands between white space on its own, so
a column of texts is cut into such units, each distinct unit is encoded once
by the tokenizers library, and its ids are gathered after that. The result is
that of encoding the whole text; tests hold the two against each other.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridweave.llm.shared import held, parts

#: Units whose ids a worker keeps, the first it meets; further ones are encoded once in each call.
KEPT_UNITS = 1 << 18
#: Longer units are not kept.
KEPT_LENGTH = 128
#: Bytes of texts whose units are looked up together, and units encoded as one text.
TOGETHER, JOINED = 1 << 21, 1000

_SPACE = "\t-\r \x85\xa0  -     　"
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-/:-@\[-`{-~"
#: White space up to the last one before a word; letters, with a blank before
#: them, up to white space or an ASCII mark; else all up to white space; other
#: white space. No token reaches over the ends of such units: letters end at a
#: mark in either kind of tokenizer, and what starts with a mark stays whole.
_UNITS = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])| ?[{_LETTERS}]+(?=[{_SPACE}{_MARKS}]|$)| ?[^{_SPACE}]+|[{_SPACE}]")

#: Texts whose white space is not just single blanks and one or two line ends between other characters.
_ODD = f"[\\x00\t\x0b-\r{_SPACE[4:]}]|  | \n|\n |\n\n\n|^[ \n]|[ \n]$"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes.

    spaces: white space belongs to the tokens (byte-level BPE); else it only
    separates them (word BPE). kept, together: units that stay known, and bytes
    of texts that are looked up together: memory against time.
    """

    def __init__(self, path: str, spaces: bool, kept: int = KEPT_UNITS, together: int = TOGETHER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer, self._spaces, self._ids, self._room, self._at_once = Tokenizer.from_file(path), spaces, {}, kept, together
        added = self._tokenizer.get_added_tokens_decoder()
        names = "|".join(re.escape(t.content) for t in added.values())
        # Word BPE is looked up in lower case: what is an added token only in lower case must not become one.
        self._added = names or None
        #: An added token that takes nothing beside it: what stands on either side is encoded on its own.
        plain = (k for k, t in added.items() if not (t.normalized or t.lstrip or t.rstrip or t.single_word))
        self._end = next(plain, None)
        self._mark = added[self._end].content if self._end is not None else ""

    @classmethod
    def of(cls, *args) -> "Encoder":
        """The encoder of this Python worker."""
        return held((cls, *args), lambda: cls(*args))

    def _texts(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode(self, units: list[str]) -> list[bytes]:
        """The ids of units that hold no added token: many as one text, with an added token between them."""
        if self._end is None:
            return self._texts(units)
        out: list[bytes] = []
        for k in range(0, len(units), JOINED):
            raw = self._texts([self._mark.join(units[k : k + JOINED])])[0]
            ends = (4 * np.nonzero(np.frombuffer(raw, "<u4") == self._end)[0]).tolist()
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(raw)], strict=True)]
        return out

    def _units(self, text: str) -> list[str]:
        return _UNITS.findall(text) if self._spaces else [u.decode() for u in text.encode().lower().split()]

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The units of plain texts."""
        if not self._spaces:
            return pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        return pc.split_pattern(ends, "\0")

    def _known(self, units: list[str]) -> list[bytes]:
        """The ids of distinct units."""
        kept = self._ids
        new = [u for u in units if u not in kept]
        room = len(kept) < self._room
        kept.update(zip(new, self._encode(new), strict=True))
        found = list(map(kept.__getitem__, units))
        for u in new:
            if not room or len(u) > KEPT_LENGTH:
                del kept[u]
        return found

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """For each text its ids; a null text is an empty one."""
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        out: list[bytes] = []
        for b in parts([pa.record_batch([column.fill_null("")], ["text"])], "text", self._at_once, 1 << 14):
            out += self._together(b.column(0))
        return out

    def _together(self, texts: pa.Array) -> list[bytes]:
        whole, plain = np.zeros(len(texts), bool), np.ones(len(texts), bool)
        if self._added is not None:
            whole = pc.match_substring_regex(texts, self._added, ignore_case=not self._spaces).to_numpy(zero_copy_only=False)
        if self._spaces:
            plain = ~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain &= ~whole
        out: list[bytes] = [b""] * len(texts)
        self._gather(self._cut(texts.filter(pa.array(plain))), np.nonzero(plain)[0], out)
        for k in np.nonzero(~plain)[0].tolist():
            text = texts[k].as_py()
            # An added token ends the white space before it too: such texts are not cut.
            if whole[k]:
                out[k] = self._texts([text])[0]
            else:
                units = self._units(text)
                known = dict(zip(own := list(dict.fromkeys(units)), self._known(own), strict=True))
                out[k] = b"".join(map(known.__getitem__, units))
        return out

    def _gather(self, lists: pa.ListArray, places: np.ndarray, out: list[bytes]) -> None:
        """Puts the ids of each list of units at its place."""
        if not len(lists):
            return
        coded, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        unit, found = coded.indices.to_numpy(), self._known(coded.dictionary.to_pylist())
        # Texts are so few that 32 bits hold all places.
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts, flat = np.cumsum(sizes, dtype=np.int32) - sizes, np.frombuffer(b"".join(found), "<u4")
        many = sizes[unit]
        upto = np.zeros(len(unit) + 1, np.int32)
        np.cumsum(many, out=upto[1:])
        at = np.repeat(starts[unit] - upto[:-1], many)
        at += np.arange(upto[-1], dtype=np.int32)
        ids, cuts = flat[at].tobytes(), (4 * upto[ends].astype(np.int64)).tolist()
        for k, a, b in zip(places.tolist(), cuts[:-1], cuts[1:], strict=True):
            out[k] = ids[a:b]
