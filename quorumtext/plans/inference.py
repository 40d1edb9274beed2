"""The boundary to recognisers, translators and language services: named batch models, called on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A loader makes, once per task, a function from a frame of inputs to a frame of results.
Loader = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
_MODELS: dict[str, tuple[Loader, str]] = {}


def register(name: str, loader: Loader, schema: str) -> None:
    """Make a model known by name; `schema` is that of its result rows."""
    _MODELS[name] = loader, schema


def names() -> list[str]:
    return sorted(_MODELS)


def predict(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows that a registered model makes of the given columns. Filter before: nothing is pushed below a model."""
    if name not in _MODELS:
        raise KeyError(f"no model {name!r}; known: {names()}")
    loader, schema = _MODELS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for frame in frames:
            yield model(frame)

    return df.select(*columns).mapInPandas(run, schema)


def predict_all(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Rows that several registered models of one schema make of the given columns, with `member`, the model's place, and `model`, its name.

    All models get a batch while it is there, so df is made once, however many there are.
    """
    if unknown := [n for n in names if n not in _MODELS]:
        raise KeyError(f"no models {unknown}; known: {sorted(_MODELS)}")
    own = [(n, *_MODELS[n]) for n in names]
    schema, *others = [s for _, _, s in own]
    if any(s != schema for s in others):
        raise ValueError(f"models {names} return different columns")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [(k, name, loader()) for k, (name, loader, _) in enumerate(own)]
        for frame in frames:
            for k, name, model in models:
                yield model(frame).assign(member=k, model=name)

    return df.select(*columns).mapInPandas(run, f"{schema}, member int, model string")


def weighted(df: DataFrame, weights: dict[str, float], model: str = "model") -> DataFrame:
    """df with `weight` by model name, 1.0 where none is given."""
    own = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(w))]) if weights else None
    return df.withColumn("weight", F.coalesce(own[F.col(model)], F.lit(1.0)) if own is not None else F.lit(1.0))


def shown(df: DataFrame, model: str = "model") -> DataFrame:
    """Rows of models proper: test-time variants have an underscore in their names."""
    return df.where(~F.col(model).contains("_"))


def prompt(df: DataFrame, key: str, line: str, reading: str, members: str) -> DataFrame:
    """(key, body): the numbered request of a page, with every member's reading below each line; a page has a bounded number of lines."""
    names_ = F.array_join(F.transform(members, lambda m, i: F.concat(F.lit("\n   recogniser "), F.char(i + 65), F.lit(": "), m)), "")
    item = F.concat(F.col(line).cast("string"), F.lit(". reading: "), F.col(reading), names_)
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, item.alias("t")))), lambda x: x["t"]), "\n").alias("body"))


def read_pages(pages: DataFrame, readers: list[str], *, page: str = "page", rows: str = "rows", first: int = 60) -> DataFrame:
    """(page, line, text, unsure, shown) of page images, given as arrays of rows of grey levels.

    Pages that are one line are taken whole; others are cut into lines, whose boxes are refined and
    clipped, `first` of a page at most. Every registered reader gets (page, line, crop) and returns (page, line, text,
    conf). Their texts are aligned, voted on, constrained and tidied, and lines without letters left out.
    """
    from ..operators import boxes, network, script, signal
    from .storage import cut

    own = pages.select(F.col(page).alias("page"), F.col(rows).alias("rows")).withColumns({"h": F.size("rows"), "w": F.coalesce(F.size(F.get("rows", F.lit(0))), F.lit(0))})
    whole = F.array(F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("w").alias("x1"), F.col("h").alias("y1")))
    found = own.where(~signal.single_line("h", "w")).withColumn("boxes", signal.page_lines("rows"))
    several = boxes.refine(found, "page", "rows", "boxes").select("page", "rows", "h", "w", F.col("refined").alias("boxes"))
    every = several.unionByName(own.where(signal.single_line("h", "w")).withColumn("boxes", whole.cast(signal.BOXES)))
    # Boxes are clipped and the first of a page kept within its array, as boxes.clipped() does with rows: pixels move only into crops.
    cut_ = F.transform("boxes", lambda b, i: F.struct(i.alias("line"), F.greatest(b["x0"], F.lit(0)).alias("x0"), F.greatest(b["y0"], F.lit(0)).alias("y0"), F.least(b["x1"], "w").alias("x1"), F.least(b["y1"], "h").alias("y1")))
    kept = F.slice(F.filter(cut_, lambda b: (b["x1"] - b["x0"] > 10) & (b["y1"] - b["y0"] > 8)), 1, first)
    lines = every.select("page", "rows", F.explode(kept).alias("b")).select("page", "rows", "b.*")
    crops = lines.select("page", "line", F.expr("transform(slice(rows, y0 + 1, y1 - y0), r -> slice(r, x0 + 1, x1 - x0))").alias("crop"))
    read = predict_all(crops, readers, ["page", "line", "crop"])
    hyps = network.hypotheses(read, ["page", "line"], [], hyp="text", conf="conf")
    voted = cut(network.combine(hyps))
    tidy = voted.select("page", "line", "shown", script.tidied("text", "unsure").alias("t"))
    return tidy.select("page", "line", "t.text", "t.unsure", "shown").where(script.worth_keeping("text"))
