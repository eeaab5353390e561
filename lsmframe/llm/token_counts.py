"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Each task holds the pre-token frequencies of one document at a time and a table pre-token -> pieces that lives as long as
the Python worker, of a bounded number of entries. The join is a look-up in that table, so nothing is shuffled: a table of
all distinct pre-tokens joined to all (document, pre-token) pairs would move more bytes than the texts have.

Nulls and empty texts count 0 tokens; a null id stays null; repeated rows each get their row; an empty table gives none;
only the named columns are read, whatever else the table has.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, text_list, tidy
from .tokens import PieceCounts

LIMIT = 512
TOKENIZER = "byte_bpe_50k.json"
_TABLES: dict[str, PieceCounts] = {}
#: White space next to white space, or at either end: there single spaces don't simply begin the next pre-token.
UNEVEN = re.compile(r"\s\s|\A\s|\s\Z|[^\S \n]")
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def frequencies(text: str) -> Counter:
    """Units of a text with their counts; a unit keeps the white space before it."""
    if UNEVEN.search(text):
        return Counter(CUT.split(text))
    first, *rest = text.replace("\n", " \n").split(" ")
    units = Counter({p if p[0] == "\n" else " " + p: n for p, n in Counter(rest).items()})
    units[first] += 1
    return units


def count_text(counts: PieceCounts, text: str) -> int:
    if not text:
        return 0
    if not counts.by_word:
        return len(counts.tok.encode(text, add_special_tokens=False).ids)
    known = counts.known
    return sum([n * known[u] for u, n in frequencies(text).items()])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit. tokenizer: path of a tokenizers .json that all executors can read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counts = _TABLES.get(tokenizer)
        if counts is None:
            counts = _TABLES[tokenizer] = PieceCounts(tokenizer)
        for b in (part for whole in batches for part in slices(whole, 1)):
            texts = text_list(b.column(1))
            n = [count_text(counts, x) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
