"""Held-out items whose text, whole or in part, appears in a corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Consecutive words of an item that are a leak; and the share of its words in order that is one, within a stretch of so many times its length.
RUN, SHARE, STRETCH = 12, (3, 5), (3, 2)
#: Characters of the items that one pass over the corpus takes (an index of some 500 MB at most); more take more passes.
ITEM_CHARS = 48_000_000
#: Characters of a corpus batch that are worked on at a time, words of a slice, and cells of an array of shared grams or of an alignment.
CHUNK, SLICE, CELLS = 400_000, 100_000, 2_000_000
#: Words of a document from one word of a pair to the other that are looked at for items of any length.
REACH = 8
#: Vocabulary times items up to which single words are counted in dense arrays; beyond, pairs of words by their postings. Both find the same.
DENSE = 1_000_000

# ---------------------------------------------------------------- words as a reader sees them

_SEP = "\x1e"
#: Elements that a browser sets inside a line; other tags part words.
_INLINE = "a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|tt|u"
_INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>\x1e]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>\x1e]*)?/?>|<!--[^\x1e]*?-->")
_ESCAPED = re.compile(r'\\(?:u([0-9a-fA-F]{4})|([nrtbf])|(["\\/]))')
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t]*(?:(?:[>*#|]|//)[ \t]*)*(?=[^\W\d_])")
_SOFT = re.compile(r"\xad[ \t]*\r?\n[ \t]*(?:(?:[>*#|]|//)[ \t]*)*(?=[^\W\d_])")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
#: Invisible: soft hyphen, fillers, zero-width and direction marks, variation selectors.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]+")
_SPACE = re.compile(r"\s+")
_SIGNS = re.compile(r"[^\w\s\u0300-\u036f]+")
#: Cyrillic and Greek letters that look like Latin ones.
_ALIKE = str.maketrans(
    "авекмнорстухіјѕһԁԛԝӏүαβεικνορτυχ",
    "abekmhopctyxijshdqwlyabeikvoptux",
)
_CONTROLS = bytes(b for b in [*range(9), *range(14, 32), 127] if b != 0x1E)
_TO_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 or b == 0x1E else 32 for b in range(256))


class _Beyond(dict):
    """What runs of characters outside ASCII read as; kept for those that come again."""

    def __missing__(self, run: str) -> str:
        read = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", _HIDDEN.sub("", run)).casefold())
        read = _SIGNS.sub(" ", read.translate(_ALIKE))
        read = _SPACE.sub(" ", read)
        if len(run) <= 4:
            if len(self) > 50_000:
                self.clear()
            self[run] = read
        return read


_beyond = _Beyond()


def _unescape(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " " if m[2] else m[3]


def _unquote(m: re.Match) -> str:
    data = bytes.fromhex(m[0].replace("%", ""))
    try:
        return data.decode().replace(_SEP, " ")  # the separators are placed by now
    except UnicodeDecodeError:
        return m[0]


def reader_words(texts: list[str | None]) -> list[bytes]:
    """The words of the texts in order, ``_SEP`` between two texts.

    Words are runs of letters and digits, case folded and decomposed, after tags, character references, JSON and percent
    escapes, compatibility forms, invisible characters, hyphens at line ends and look-alike letters are resolved.
    """
    text = f" {_SEP} ".join([(t or "").replace(_SEP, " ") for t in texts])
    if "\\" in text:
        text = _ESCAPED.sub(_unescape, text).encode("utf-16", "surrogatepass").decode("utf-16", "replace").replace("\x00", "")
        if text.count(_SEP) != len(texts) - 1:  # an escape named the separator
            return reader_words([(t or "").replace("\\u001e", " ").replace("\\u001E", " ") for t in texts])
    if "%" in text:
        text = _PERCENT.sub(_unquote, text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "\x1b" in text:
        text = _ANSI.sub("", text)
    if "-" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _SOFT.sub("", text) if "\xad" in text else text
        text = _BEYOND.sub(lambda m: _beyond[m[0]], text)
    return text.encode().translate(_TO_WORDS, _CONTROLS).split()


# ---------------------------------------------------------------- items


class Items:
    """The held-out items as arrays: their words, the places of runs of twelve, and their grams.

    Of an item's n words a leak keeps k at least, in order, within a stretch of s words. Grams are words with their boundaries where the
    items are few: an edit takes away one of them, so a leak shares k of them, each as often as both have it. Where they are many, grams are
    pairs of neighbouring words, which are far rarer: the lost words part the kept ones into n - k + 1 runs at most, so m = 2k - n - 1 neighbours
    are kept at least; their distances in the document add up to s - k + m at most, hence all but (s - k) / reach of them are no further apart than
    ``reach``: the bound that a region has to meet. Items too short for a bound of one also have the pairs of words with one between them.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        texts: list[list[bytes]] = [[]]
        for w in reader_words([t for _, t in items]):
            if w == _SEP.encode():
                texts.append([])
            else:
                texts[-1].append(w)
        kept = sorted(((i, t) for (i, _), t in zip(items, texts) if t), key=lambda x: len(x[1]))
        del texts
        self.vocabulary: dict[bytes, int] = {}
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.sizes = np.array([len(t) for _, t in kept], np.int64)
        self.flat = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for _, t in kept for w in t), np.int32, int(self.sizes.sum()))
        self.size = len(self.vocabulary) + 1
        self.vocabulary[_SEP.encode()] = -1
        self.first = np.cumsum(self.sizes) - self.sizes
        self.needed = -(-self.sizes * SHARE[0] // SHARE[1])
        self.stretch = self.sizes * STRETCH[0] // STRETCH[1]
        self.stride = np.maximum(4, self.stretch // 3)
        kept_pairs = np.maximum(1, 2 * self.needed - self.sizes - 1)
        spare = self.stretch - self.needed
        self.reach = np.maximum(REACH, spare // kept_pairs + 1)
        self.bound = kept_pairs - spare // self.reach
        self.runs = self._runs()
        self.dense = self.size * len(self.sizes) <= DENSE
        self.classes = self._classes() if self.dense else []
        self.pairs = None if self.dense else self._pairs()

    def _classes(self):
        """Items of like length with the stride and number of blocks of their bands, and their counted words."""
        out, a = [], 0
        while a < len(self.sizes):
            b = int(np.searchsorted(self.sizes, -(-self.sizes[a] * 5 // 4), "right"))
            longest = int(self.stretch[b - 1])
            stride = max(4, longest // 3)
            counts = np.stack([np.bincount(self.flat[f : f + n], minlength=self.size) for f, n in zip(self.first[a:b], self.sizes[a:b])])
            most = counts.max(axis=0)
            grams = [(np.flatnonzero(most >= m), m) for m in range(1, int(most.max()) + 1)]
            own = np.concatenate([counts[:, w] >= m for w, m in grams], axis=1).T.astype(np.float32)
            out.append((a, b, stride, -(-(longest + stride - 1) // stride), grams, np.ascontiguousarray(own)))
            a = b
        return out

    def _postings(self, codes: np.ndarray, owner: np.ndarray, *more: np.ndarray):
        """Distinct (code, item), sorted: the codes, where each one's postings begin, the items, and the first ``more`` of each."""
        by = np.lexsort((owner, codes))
        codes, owner = codes[by], owner[by]
        new = np.ones(len(by), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        codes, owner = codes[new], owner[new].astype(np.int32)
        heads = np.flatnonzero(np.diff(codes, prepend=codes[:1] + 1)) if len(codes) else np.empty(0, np.int64)
        known = codes[heads]
        bits = int(np.clip(len(known).bit_length() + 3, 12, 26))
        table = np.zeros(1 << bits, bool)
        table[_slot(known, bits)] = True
        return known, np.append(heads, len(codes)), owner, table, bits, *(m[by][new] for m in more)

    def _runs(self):
        owner, place = np.repeat(np.arange(len(self.sizes)), self.sizes), np.arange(len(self.flat))
        whole = place - self.first[owner] <= self.sizes[owner] - RUN
        at = np.flatnonzero(whole)
        return self._postings(run_hashes(self.flat)[at] if len(at) else np.empty(0, np.uint64), owner[at], place[at])

    def _pairs(self):
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        codes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for step in (1, 2):
            at = np.flatnonzero(owner[: len(owner) - step] == owner[step:])
            at = at if step == 1 else at[2 * self.needed[owner[at]] - self.sizes[owner[at]] < 2]
            codes.append(self.flat[at].astype(np.uint64) * np.uint64(self.size) + self.flat[at + step].astype(np.uint64))
            owners.append(owner[at])
        return self._postings(np.concatenate(codes), np.concatenate(owners))


_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(RUN)], np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * _ODD[0]) >> np.uint64(64 - bits)).astype(np.int64)


def run_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each RUN consecutive word ids."""
    w = words.astype(np.uint64) * _MIX
    w ^= w >> np.uint64(29)
    n = len(w) - RUN + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(RUN if n > 0 else 0):
        h += w[k : k + n] * _ODD[k]
    return h * _MIX


# ---------------------------------------------------------------- search


def leaks_of(texts: list[str | None], items: Items) -> list[tuple[int, int]]:
    """(number of the text, number of the item) of each leak."""
    n = len(items.ids)
    if not n or not texts:
        return []
    words = reader_words(texts)
    ids = np.fromiter(map(items.vocabulary.get, words, repeat(0)), np.int32, len(words))
    del words
    cuts = np.flatnonzero(ids == -1)
    begin, end = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]])
    ids[cuts] = 0  # like words that no item has
    found = _runs_shared(ids, begin, end, items)
    for doc, item, start, last in _regions_counted(ids, begin, end, items):
        found = _confirmed(ids, end, doc, item, start, last, items, found)
    if items.dense:
        return [(int(k // n), int(k % n)) for k in found]
    overlap = int(items.stretch.max() + items.stride.max()) + 1
    for low in range(0, len(ids), SLICE):
        found = _pairs_shared(ids, begin, end, low, min(low + SLICE, len(ids)), overlap, items, found)
    return [(int(k // n), int(k % n)) for k in found]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all values of the ranges."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - (np.cumsum(n) - n)[of] + low[of]


def _met(codes: np.ndarray, postings) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``codes``, number of the known code) of those that items have."""
    known, table, bits = postings[0], postings[3], postings[4]
    at = np.flatnonzero(table[_slot(codes, bits)])
    rank = np.searchsorted(known, codes[at])
    same = known[np.minimum(rank, len(known) - 1)] == codes[at]
    return at[same], rank[same]


def _runs_shared(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, items: Items) -> np.ndarray:
    """Text and item, as one number, of the twelve-word runs that both have: a hash, then the words themselves."""
    out = [np.empty(0, np.int64)]
    heads, owner, place = items.runs[1], items.runs[2], items.runs[5]
    if not len(owner):
        return out[0]
    hashes = run_hashes(ids)
    span = np.arange(RUN)
    at, rank = _met(hashes, items.runs) if len(hashes) else (out[0], out[0])
    doc = np.searchsorted(begin, at, "right") - 1
    within = at + RUN <= end[doc]
    at, rank, doc = at[within], rank[within], doc[within]
    many = heads[rank + 1] - heads[rank]
    room = max(1, CELLS // RUN)
    cuts = np.searchsorted(np.cumsum(many), np.arange(room, int(many.sum()) + room, room), "left") + 1
    for a, b in zip([0, *cuts], cuts):
        of, post = _ranges(heads[rank[a:b]], heads[rank[a:b] + 1])
        key, where = np.unique(doc[a:b][of] * len(items.ids) + owner[post], return_index=True)
        # Copies of a run in one text or item are one; the first of each is compared, a hash deciding for its copies.
        at1, place1 = at[a:b][of[where]], place[post[where]]
        out.append(key[(ids[at1[:, None] + span] == items.flat[place1[:, None] + span]).all(axis=1)])
    return np.unique(np.concatenate(out))


def _regions_counted(ids, begin, end, items: Items) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, first start, end of the starts) of the bands that share enough words with an item, in slices of bounded size."""
    at = np.flatnonzero(ids > 0) if items.classes else np.empty(0, np.int64)
    words = ids[at].astype(np.int64)
    owner = np.searchsorted(begin, at, "right") - 1
    offset = at - begin[owner]
    for a, b, stride, blocks, grams, own in items.classes:
        per_doc = -(-(end - begin) // stride)
        first = np.concatenate([[0], np.cumsum(per_doc)])
        total = int(first[-1])
        doc = np.repeat(np.arange(len(begin)), per_doc)
        block = first[owner] + offset // stride
        step = max(blocks, 4 * CELLS // max(items.size, len(own), b - a))
        for low in range(0, total, step):
            band, item = _bands_shared(words, block, low, min(low + step, total), first[doc + 1], (a, b, stride, blocks, grams, own), items)
            if len(band):
                start = begin[doc[band]] + (band - first[doc[band]]) * stride
                yield doc[band], item, start, np.minimum(start + stride, end[doc[band]])


def _bands_shared(words, block, low, high, ends, of_class, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(band, item) of the bands ``low`` to ``high`` that share enough grams; the blocks that the last ones reach into are counted too."""
    a, b, stride, blocks, grams, own = of_class
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    beyond = min(high + blocks - 1, len(ends))
    part = slice(*np.searchsorted(block, [low, beyond]))
    counts = np.bincount((block[part] - low) * items.size + words[part], minlength=(beyond - low) * items.size)
    counts = counts.astype(np.int16 if stride * blocks < 32_000 else np.int32).reshape(beyond - low, items.size)
    left = ends[low:high] - np.arange(low, high)  # blocks of the document from here on
    held = counts[: high - low].copy()
    for j in range(1, min(blocks, beyond - low)):
        n = min(high - low, beyond - low - j)
        held[:n] += counts[j : j + n] * (left[:n, None] > j)
    enough = np.flatnonzero(held.sum(axis=1, dtype=np.int32) >= items.needed[a])
    if not len(enough):
        return none
    held = held[enough]
    shared = np.concatenate([held[:, w] >= m for w, m in grams], axis=1).astype(np.float32) @ own
    band, item = np.nonzero(shared >= items.needed[a:b])
    return enough[band] + low, item + a


def _pairs_shared(ids, begin, end, low: int, high: int, overlap: int, items: Items, found: np.ndarray) -> np.ndarray:
    """Adds what has enough words in order and begins in the slice: regions that share enough grams, then alignment within them."""
    stop = min(high + overlap, len(ids))
    at = low + np.flatnonzero(ids[low:stop] > 0)
    doc = np.searchsorted(begin, at, "right") - 1
    if items.sizes[0] == 1:  # an item of one word is in every text that has it
        singles = items.flat[: int(np.searchsorted(items.sizes, 1, "right"))]
        by = np.argsort(singles, kind="stable")
        has = np.unique(doc * items.size + ids[at])
        a, b = (np.searchsorted(singles[by], has % items.size, side) for side in ("left", "right"))
        of, post = _ranges(a, b)
        found = np.union1d(found, has[of] // items.size * len(items.ids) + by[post])
    if not len(items.pairs[0]):
        return found
    places, ranks, apart = [], [], []
    for d in range(1, int(items.reach.max()) + 1):
        near = at[(at + d < end[doc])]
        near = near[ids[near + d] > 0]
        k, rank = _met(ids[near].astype(np.uint64) * np.uint64(items.size) + ids[near + d].astype(np.uint64), items.pairs)
        places.append(near[k])
        ranks.append(rank)
        apart.append(np.full(len(k), d))
    hits = tuple(map(np.concatenate, (places, ranks, apart)))
    ranges = [(0, len(items.ids))]
    while ranges:  # as many items at once as the hits of them all have room for
        a, b = ranges.pop()
        of, item = _hits_of(hits[1], a, b, items)
        if of is None:
            ranges += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        keep = hits[2][of] <= items.reach[item]
        found = _confirmed(ids, end, *_regions_paired(begin, end, hits[0][of[keep]], item[keep], items, found), items, found)
    return found


def _hits_of(ranks: np.ndarray, a: int, b: int, items: Items):
    """(number of the hit, item) of the items from ``a`` to ``b``; None if these are too many at once."""
    heads, owner = items.pairs[1], items.pairs[2]
    low, high = heads[ranks], heads[ranks + 1]
    if a or b < len(items.ids):  # postings are sorted by item within a gram
        low, high = _bisect(owner, low, high, a), _bisect(owner, low, high, b)
    if int((high - low).sum()) > CELLS and b - a > 1:
        return None, None
    of, post = _ranges(low, high)
    return of, owner[post]


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, x: int) -> np.ndarray:
    """The first place within each range, sorted in itself, whose value is at least ``x``."""
    low, high = low.copy(), high.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) // 2
        less = (low < high) & (values[np.minimum(mid, len(values) - 1)] < x)
        high = np.where(less, high, np.where(low < high, mid, high))
        low = np.where(less, mid + 1, low)
    return low


def _regions_paired(begin, end, place, item, items: Items, found: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, first start, end of the starts) of the bands whose shared pairs reach the bound."""
    doc = np.searchsorted(begin, place, "right") - 1
    block = (place - begin[doc]) // items.stride[item]
    wide = int(block.max(initial=0)) + int(-(-(items.stretch + items.stride) // items.stride).max()) + 2
    pair = doc * len(items.ids) + item
    fresh = ~np.isin(pair, found)
    keys, counts = np.unique(pair[fresh] * wide + block[fresh], return_counts=True)
    doc, item, block = keys // wide // len(items.ids), keys // wide % len(items.ids), keys % wide
    spans = -(-(items.stretch[item] + items.stride[item] - 1) // items.stride[item])
    total = np.concatenate([[0], np.cumsum(counts)])
    shared = total[np.searchsorted(keys, keys + spans)] - total[: len(keys)]
    some = shared >= items.bound[item]
    doc, item, block = doc[some], item[some], block[some]
    # A stretch whose first shared pair lies in the block begins up to a stretch before it.
    start = np.maximum(begin[doc] + block * items.stride[item] - items.stretch[item] + 1, begin[doc])
    return doc, item, start, np.minimum(begin[doc] + (block + 1) * items.stride[item], end[doc])


def _confirmed(ids, end, doc, item, start, last, items: Items, found: np.ndarray) -> np.ndarray:
    """Adds the texts and items whose regions, aligned, have enough words in order."""
    pair = doc * len(items.ids) + item
    fresh = ~np.isin(pair, found)
    pair, doc, item, start, last = (x[fresh] for x in (pair, doc, item, start, last))
    order = np.argsort(item, kind="stable")
    out = [found]
    while len(order):
        room = np.cumsum(2 * items.stretch[item[order]] + items.stride[item[order]])
        least = int(items.sizes[item[order[0]]])  # items of like length, so that their bit vectors are
        n = max(1, min(int(np.searchsorted(room, CELLS // -(-least // 64))), int(np.searchsorted(items.sizes[item[order]], 2 * least + 64))))
        part, order = order[:n], order[n:]
        good = part[_aligned(ids, start[part], last[part], end[doc[part]], item[part], items)]
        out.append(np.unique(pair[good]))
        order = order[~np.isin(pair[order], out[-1])] if len(good) else order
    return np.unique(np.concatenate(out))


def _aligned(ids, start, last, limit, item, items: Items) -> np.ndarray:
    """Whether some stretch that begins from ``start`` up to before ``last`` has enough words of the item in order.

    The region as a whole is aligned first, then ever shorter windows over ever fewer starts; what a window lacks none of its stretches has.
    """
    local, of = np.unique(item, return_inverse=True)
    masks, row_of = _masks(local, items)
    who = np.arange(len(item))
    width = last - start  # starts that a window stands for
    passed = np.zeros(len(item), bool)
    while len(who):
        stop = np.minimum(start + width - 1 + items.stretch[item[who]], limit[who])
        enough = _common(ids, start, stop, of[who] * items.size, items.sizes[item[who]], masks, row_of) >= items.needed[item[who]]
        passed[who[enough & (width == 1)]] = True
        more = enough & (width > 1) & ~passed[who]
        who, start, width = who[more], start[more], width[more]
        parts = np.minimum(width, max(4, 20_000 // max(1, len(who) * masks.shape[1])))
        row, k = _ranges(np.zeros(len(who), np.int64), parts)
        size = -(-width // parts)
        begins = start[row] + k * size[row]
        own = np.minimum(size[row], start[row] + width[row] - begins)
        real = own > 0
        who, start, width = who[row[real]], begins[real], own[real]
    return passed


def _masks(local: np.ndarray, items: Items):
    """Bit vectors of the places of each word in each of a few items, and a function that gives the row of (item, word) keys; row 0 is empty."""
    of, at = _ranges(items.first[local], items.first[local] + items.sizes[local])
    place = at - items.first[local[of]]
    keys, row = np.unique(of * items.size + items.flat[at], return_inverse=True)
    masks = np.zeros((len(keys) + 1, -(-int(items.sizes[local].max()) // 64)), np.uint64)
    np.bitwise_or.at(masks, (row + 1, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    if len(local) * items.size <= CELLS:
        rows = np.zeros(len(local) * items.size, np.int32)
        rows[keys] = np.arange(1, len(keys) + 1)
        return masks, rows.__getitem__

    def searched(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at + 1, 0)

    return masks, searched


def _common(ids, start, stop, base, full, masks, row_of) -> np.ndarray:
    """Longest common subsequence of each word stretch and its item, all bit vectors advancing together."""
    limbs = masks.shape[1]
    out = np.empty(len(start), np.int64)
    step = max(1, CELLS // limbs)
    for a in range(0, len(start), step):
        part = slice(a, a + step)
        bits = np.clip(full[part, None] - 64 * np.arange(limbs), 0, 64)
        ones = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
        v = ones.copy()
        own, begins, ends = base[part], start[part], stop[part]
        for j in range(int((ends - begins).max(initial=0))):
            at = begins + j
            m = masks[row_of(own + np.where(at < ends, ids[np.minimum(at, len(ids) - 1)], 0))]
            u = v & m
            total = v + u
            carry = total < v
            for k in range(1, limbs):
                over = total[:, k] + carry[:, k - 1].astype(np.uint64)
                carry[:, k] |= over < total[:, k]
                total[:, k] = over
            v = (total | (v & ~m)) & ones
        out[part] = full[part] - np.bitwise_count(v).sum(axis=1).astype(np.int64)
    return out


# ---------------------------------------------------------------- Spark


def item_blocks(items: DataFrame, item_id: str, text: str, chars: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of so many characters (one item at least), the bound of a broadcast."""
    held: list[tuple[int, str]] = []
    size, chars = 0, chars or ITEM_CHARS
    for r in items.select(item_id, text).where(f"`{text}` is not null and `{item_id}` is not null").distinct().orderBy(item_id, text).toLocalIterator():
        if held and size + len(r[1]) > chars:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_chars: int | None = None) -> DataFrame:
    """``(doc_id, item_id)`` of each document that carries an item.

    A document carries an item if it has twelve consecutive words of it, or at least three fifths of its words in
    their order within a stretch of at most one and a half times its length. Words are what ``reader_words`` gives. Null, empty and blank
    texts carry nothing and are carried by none. Copies give one row. Without items or documents there are no rows.

    The corpus is read once for each block of ``item_chars`` characters of items and never shuffled but for the distinct result; the
    index of a block is made once and broadcast. Grams are words, or pairs of neighbouring ones where the items are many; the edit budget
    says how many of them a leak shares at least (``Items``). Shared grams are counted in overlapping bands (a window of the document against the whole item); bands that
    reach the bound are aligned by bit vectors, then ever shorter windows of them down to the stretches. Work is done in slices of bounded
    size, whatever the number of items or the length of a text; nothing is lost or capped.
    """
    spark: SparkSession = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    ddl = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}"
    parts = []
    for block in item_blocks(items, item_id, text, item_chars):
        known = spark.sparkContext.broadcast(Items(block))
        parts.append(docs.select(doc_id, text).mapInArrow(_searched(known, doc_id, item_id), ddl))
    if not parts:
        return spark.createDataFrame([], ddl)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _searched(known, doc_id: str, item_id: str):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        names = pa.array(items.ids.tolist())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.cumsum([len(t or "") + 1 for t in texts]) // CHUNK
            pairs: list[tuple[int, int]] = []
            for c in np.unique(sizes):
                a, b = np.searchsorted(sizes, [c, c + 1])
                pairs += [(int(a) + d, k) for d, k in leaks_of(texts[a:b], items)]
            rows = pa.array([d for d, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows[0]), names.take(rows[1])], names=[doc_id, item_id])

    return searched
