"""Token counts of texts as a Column, for budgets."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text: Column | str, vocabulary: str, pattern: str) -> Column:
    """Tokens of each text by a file of ranks (``.tiktoken``) on the driver and its pattern; special strings are ordinary text.

    The ranks go out with the tasks, once per process; null counts 0.
    """
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    built: list = []

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken

        if not built:
            built.append(tiktoken.Encoding("budget", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return texts.map(lambda t: len(built[0].encode_ordinary(t)) if t else 0)

    return count(text)
