"""Cutting texts beyond a token limit into overlapping pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalith.llm.tokens import Vocabulary

#: Strength of a cut: inside a character, between characters, words, sentences, lines, paragraphs.
INSIDE, CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = range(6)
#: Share of more pieces, beyond the least number, that a text may get so that every cut falls between words.
MORE_PIECES = (0, 1 / 1000, 1 / 16, 1 / 8, 1 / 4)


def cut_strengths(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Strength of a cut before each token; ``data`` the text's UTF-8 bytes, ``starts`` where the tokens begin."""
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    third, second, last, here = (padded[starts + k] for k in range(4))
    blank = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
    broken = (last == 10) & (here != 10) & (here != 13)
    paragraph = broken & ((second == 10) | ((second == 13) & (third == 10)))
    wide = (third == 0xE3) & (second == 0x80) & (last == 0x82) | (third == 0xEF) & (second == 0xBC) & ((last == 0x81) | (last == 0x9F))
    sentence = wide | (blank(here) & ((last == 46) | (last == 33) | (last == 63)))
    strength = np.where((here & 0xC0) != 0x80, CHARACTER, INSIDE)
    strength[blank(here) | blank(last)] = WORD
    strength[sentence] = SENTENCE
    strength[broken] = LINE
    strength[paragraph] = PARAGRAPH
    return strength


def place_cuts(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Token positions at which the pieces after the first begin, before their overlap is added.

    The least number of pieces gets equal targets; each cut goes to the strongest place near its target, the
    nearest of equals, or wherever the limits allow if there is none between words nearby. If some cut still falls
    inside a word, more pieces are tried.
    """
    total, step = len(strength), limit - overlap
    if total <= limit:
        return []
    least = -(-(total - overlap) // step)
    best: tuple[int, list[int]] | None = None
    for n in dict.fromkeys(least + -int(-least * more // 1) for more in MORE_PIECES):
        size = (total + (n - 1) * overlap) / n
        cuts, weakest, at = [], PARAGRAPH, 0
        for k in range(1, n):
            target = round(size + (k - 1) * (size - overlap))
            furthest = min(at + (step if at else limit), total - 1)
            nearest = min(max(at + 1, overlap, total - (n - k) * step), furthest)
            for reach in (step // 4, total):
                low, high = min(max(nearest, target - reach), furthest), max(min(furthest, target + reach), nearest)
                near = strength[low : high + 1]
                if near.max() >= WORD:
                    break
            places = np.arange(low, high + 1)
            top = near == near.max()
            at = int(places[top][np.argmin(np.abs(places[top] - target))])
            weakest = min(weakest, int(near.max()))
            cuts.append(at)
        if best is None or weakest > best[0]:
            best = weakest, cuts
        if weakest >= WORD:
            break
    return best[1]


def split_text(text: str | None, vocabulary: Vocabulary, limit: int, overlap: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The ids of a text and its pieces as (first token, end, strength of the cut before it)."""
    ids = np.array(vocabulary.encode(text), np.int32)
    if len(ids) <= limit:
        return ids, [(0, len(ids), PARAGRAPH)]
    starts = np.cumsum(vocabulary.lengths(ids))
    starts = np.concatenate([[0], starts[:-1]])
    strength = cut_strengths(np.frombuffer(text.encode(), np.uint8), starts)
    cuts = place_cuts(strength, limit, overlap)
    ends = [*cuts, len(ids)]
    return ids, [(max(0, a - overlap), b, int(strength[a]) if a else PARAGRAPH) for a, b in zip([0, *cuts], ends)]


def split_corpus(docs: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary, *, limit: int = 512, overlap: int = 64, with_text: bool = True) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, cut[, text, ids])``: each text as pieces of at most ``limit`` tokens.

    Sizes count tokens of the whole text's encoding. A piece is a run of them; every piece but the first begins with the last
    ``overlap`` tokens of the one before, so the tokens beyond the overlaps give the text back exactly. ``cut`` is the
    strength of the place where it begins (0 inside a character, 1 between characters, 2 words, 3 sentences, 4 lines, 5 paragraphs; 5 too at the start).
    ``ids`` are the piece's tokens, which lose nothing; ``text`` is its text, where half a character at either end becomes U+FFFD. Texts within the limit, empty and null ones
    are one piece. Rows are independent: no shuffle, and repeated rows are cut alike.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)[doc_id]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        for batch in batches:
            row, piece, first, size, cut, texts, tokens = [], [], [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids, runs = split_text(t, v, limit, overlap)
                for p, (a, b, strength) in enumerate(runs):
                    row.append(k)
                    piece.append(p)
                    first.append(a)
                    size.append(b - a)
                    cut.append(strength)
                    if with_text:
                        tokens.append(ids[a:b])
                        texts.append(t or "" if len(runs) == 1 else v.decode_bytes(ids[a:b].tolist()).decode(errors="replace"))
            cols = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int32()) for c in (piece, first, size, cut))]
            names = [doc_id, "piece", "first_token", "n_tokens", "cut"]
            if with_text:
                cols, names = [*cols, pa.array(texts, pa.string()), pa.array(tokens, pa.list_(pa.int32()))], [*names, "text", "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = f"`{doc_id}` {kind}, piece int, first_token int, n_tokens int, cut int" + ", text string, ids array<int>" * with_text
    return docs.select(doc_id, text).mapInArrow(pieces, ddl)
