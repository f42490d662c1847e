"""Token counts of a unigram tokenizer, without making its tokens.

An Aho-Corasick automaton lists the vocabulary's matches in a segment, in order of their end and then of their start; a
dynamic programme carries the best score up to each character and that path's number of tokens. A later path replaces an
earlier one only if its score is larger, so of equal ones that with the longest last piece stays. A character without a
piece of its own may be unknown, at the lowest score less 10; it counts as its UTF-8 bytes.

Segments begin at each space, which becomes the mark U+2581; a text that doesn't begin with a space gets one. No piece
reaches over a mark into another segment, so the counts of a text's segments add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .segments import Memo, space_cuts
from .textblock import blocks

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class Unigram:
    """The vocabulary ``pieces`` -> score."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, model_file: str) -> Unigram:
        """Pieces and scores of a sentencepiece file: those that are ordinary pieces."""
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = (i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
        return cls({m.id_to_piece(i): m.get_score(i) for i in ids})

    def count(self, text: str) -> int:
        """Tokens of ``text``, in which spaces are marks already."""
        n = len(text)
        best, tokens = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        single, unknown = self.single, self.unknown
        done = 0

        def step(upto: int) -> None:  # the unknown edges into positions up to ``upto``
            nonlocal done
            while done < upto:
                c = text[done]
                if c not in single and best[done] + unknown > best[done + 1]:
                    best[done + 1], tokens[done + 1] = best[done] + unknown, tokens[done] + len(c.encode())
                done += 1

        for end, (length, score) in self.automaton.iter(text):
            if done < end:
                step(end)
            at = end + 1 - length
            if best[at] + score > best[end + 1]:
                best[end + 1], tokens[end + 1] = best[at] + score, tokens[at] + 1
        step(n)
        return tokens[n]


_loaded: dict[str, Memo] = {}


def _memo(name: str) -> Memo:
    if name not in _loaded:
        model = Unigram.load(SparkFiles.get(name))
        _loaded[name] = Memo(lambda new: [model.count(MARK + k.decode().removeprefix(" ")) for k in new])
    return _loaded[name]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens and n_chars (code points) of every row of ``docs``; null and empty texts have none.

    ``model_file`` is a sentencepiece file on the driver; Spark hands it to the executors.
    """
    docs.sparkSession.sparkContext.addFile(model_file)
    name = model_file.rsplit("/", 1)[-1]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(name)
        for batch in batches:
            texts = pc.replace_substring(batch.column("text"), MARK, " ")
            out = []
            for w in blocks(texts):
                start = space_cuts(w.data, w.ends)
                if not len(start):
                    out.append(np.zeros(w.rows, np.int64))
                    continue
                values, back = memo(w.data, start, np.r_[start[1:], len(w.data)])
                row = np.searchsorted(w.ends, start, "right") - 1
                out.append(np.bincount(row, weights=np.array(values, np.float64)[back], minlength=w.rows).astype(np.int64))
            chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), chars], ["doc_id", "n_tokens", "n_chars"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_chars long")
