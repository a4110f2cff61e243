"""Token counts by section: offset-mapped attribution.

Every document is encoded once, as a whole. Its tokens' byte spans come from the tokens'
lengths; the sections' byte spans from the text. Both lists are sorted, so the interval
join is one binary search per document, inside the task that encoded it: nothing is
shuffled. A token that crosses a border is allocated by an explicit rule:

* ``first``: to the section that holds the token's first byte (default);
* ``last``: to the section that holds its last byte;
* ``most``: to the section with most of its bytes, the earlier one on a tie.

Every token is allocated to exactly one section, so a document's sections add up to its
token count. Sections are lines with their line end by default, or any list of ends.

Pre-tokens are split by Spark; each distinct pre-token of a batch is encoded once.

Defined results: a null text has no section and no row; an empty text has one section with
no tokens; repeated rows give repeated results; an empty table gives no rows; extra columns
are left out. Offsets count code points: ``text[start:end]``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirador.llm.bpe import pretokens, ragged_take, share_ranks, word_encoder
from mirador.llm.common import read_table

RULES = ("first", "last", "most")
NAMES = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]


def section_lengths(text: str, separator: str = "\n") -> list[str]:
    """The sections of a text: pieces that end with the separator, and the rest."""
    parts = text.split(separator)
    return [p + separator for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a border."""
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crosses = first != last
    if rule == "first":
        return first, crosses
    if rule == "last":
        return last, crosses
    most = first.copy()
    for t in np.flatnonzero(crosses):       # few: tokens over a border
        lo, hi = first[t], last[t]
        begin = np.maximum(np.concatenate([[starts[t]], section_ends[lo:hi]]), starts[t])
        end = np.minimum(section_ends[lo:hi + 1], token_ends[t])
        most[t] = lo + int((end - begin).argmax())
    return most, crosses


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", sections=section_lengths,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing) per section of every document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = share_ranks(docs.sparkSession, ranks_path)

    def run(batches):
        encode = word_encoder(ranks.value)
        size = np.zeros(max(ranks.value.values(), default=-1) + 1, np.int64)
        for token, i in ranks.value.items():
            size[i] = len(token)
        for b in batches:
            coded = b.column(2).flatten().dictionary_encode()
            words = [encode(w) for w in coded.dictionary.to_pylist()]
            lens = np.array([len(w) for w in words], np.int64)
            starts = np.cumsum(lens) - lens
            flat = size[np.array([i for w in words for i in w], np.int64)]
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            out, at = [[] for _ in NAMES], 0
            for i, text, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), n.tolist()):
                own, at = which[at:at + m], at + m
                if text is None:
                    continue
                token_bytes, _ = ragged_take(flat, starts, lens, own)
                parts = sections(text)
                chars = np.cumsum([len(p) for p in parts])
                ends = np.cumsum([len(p.encode()) for p in parts])
                section, crosses = allocate(np.cumsum(token_bytes), ends, rule)
                out[0] += [i] * len(parts)
                out[1] += range(len(parts))
                out[2] += [0, *chars[:-1].tolist()]
                out[3] += chars.tolist()
                out[4] += np.bincount(section, minlength=len(parts)).tolist()
                out[5] += np.bincount(section[crosses], minlength=len(parts)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=NAMES)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    pretokens(F.col(text_col), pattern).alias("tokens"))
    return d.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


def op9_token_attribution(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every text of ``documents``."""
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
