"""Token counting, mean pooling and the model adapter."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlake.functions.text import token_count, tokens

MAX_TOKENS = 128


def counted_tokens(text: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Tokens a text is charged for: truncated like the model input."""
    return F.least(token_count(text), F.lit(max_tokens))


def token_usage(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Inputs and token totals; ``prompt_tokens`` counts truncated inputs."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_inputs"),
        F.sum(counted_tokens(F.col(text)).cast("bigint")).alias("prompt_tokens"),
        F.sum(token_count(F.col(text)).cast("bigint")).alias("untruncated_tokens"),
    )


def mean_pool(
    token_vectors: DataFrame,
    by: Sequence[str],
    vector: str = "embedding",
    mask: str = "mask",
) -> DataFrame:
    """Masked mean per dimension of all token vectors of a text.

    Vectors may have any length, the same for all tokens of a text; the job
    fails where they differ. Sums per dimension are combined map-side before
    they move. A null vector counts as a token and adds nothing.
    """
    cell = F.posexplode_outer(vector).alias("__dim", "__h")
    weight = F.col(mask).cast("double")
    cells = token_vectors.select(*by, weight.alias("__m"), cell)
    sums = cells.groupBy(*by, "__dim").agg(
        F.sum(F.col("__h").cast("double") * F.col("__m")).alias("__s"),
        F.sum("__m").alias("__w"),
        F.count("*").alias("__n"),
    )
    pooled = F.array_sort(
        F.collect_list(
            F.when(
                F.col("__dim").isNotNull(),
                F.struct("__dim", F.try_divide("__s", "__w").alias("v")),
            )
        )
    )
    known = F.col("__dim").isNotNull()
    texts = sums.groupBy(*by).agg(
        F.max(F.when(known, F.col("__n"))).alias("__most"),
        F.min(F.when(known, F.col("__n"))).alias("__least"),
        F.coalesce(F.max(F.when(~known, F.col("__n"))), F.lit(0)).alias("__empty"),
        pooled.alias("__cells"),
    )
    values = F.transform("__cells", lambda c: c["v"])
    uneven = F.raise_error(F.lit("token vectors of unequal length")).cast("array<double>")
    checked = F.when(F.coalesce(F.col("__most") != F.col("__least"), F.lit(False)), uneven).otherwise(values)
    return texts.select(
        *by,
        (F.coalesce("__most", F.lit(0)) + F.col("__empty")).alias("n_tokens"),
        checked.alias("embedding"),
    )


def token_prefix(df: DataFrame, column: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add ``n_tokens`` and ``tokens_text``: what a model is given of each row.

    A text gives its first ``max_tokens`` tokens; a column of token ids passes
    uncut. Either is joined with blanks; null stays null.
    """
    is_text = df.schema[column].dataType.typeName() == "string"
    items = (
        F.slice(tokens(F.col(column)), 1, max_tokens)
        if is_text
        else F.col(column).cast("array<string>")
    )
    return df.withColumns(
        {
            "n_tokens": F.when(F.col(column).isNotNull(), F.size(items)).cast("bigint"),
            "tokens_text": F.array_join(items, " "),
        }
    )


Encoder = Callable[[list[str]], Sequence[Sequence[float]]]

LOADED_MODELS = 10
_loaded: OrderedDict[str, Encoder] = OrderedDict()


def loaded_model(tag: str, load: Callable[[str], Encoder]) -> Encoder:
    """Model of this worker process; the ten last used stay loaded."""
    if tag not in _loaded:
        _loaded[tag] = load(tag)
    _loaded.move_to_end(tag)
    while len(_loaded) > LOADED_MODELS:
        _loaded.popitem(last=False)
    return _loaded[tag]


def encode_with_model(
    df: DataFrame,
    text: str,
    tag: str,
    load: Callable[[str], Encoder],
    name: str = "embedding",
    batch_size: int = 256,
) -> DataFrame:
    """Embed with a user's model, kept per worker and fed Arrow batches."""
    vector = T.StructField(name, T.ArrayType(T.FloatType()))
    schema = T.StructType([*df.schema.fields, vector])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = loaded_model(tag, load)
        for frame in frames:
            vectors: list = []
            for start in range(0, len(frame), batch_size):
                part = frame[text].iloc[start : start + batch_size]
                vectors.extend(list(map(float, v)) for v in encode(part.tolist()))
            if vectors:
                yield frame.assign(**{name: vectors})

    return df.mapInPandas(run, schema)
