"""Layers and rules as table functions: registered by name, called from SQL on any table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.html import Node, parse
from .extract import LAYERS

Layer = Callable[[Node, str], list]


def layer_function(layers: dict[str, Layer] | None = None) -> type:
    """A table function over pages: layer_offers(TABLE(pages) PARTITION BY (id), layer).

    The table's first column is the page's id, of any type, and comes back under its own name; columns url and html are
    read. A page or layer that fails gives a row that says so. Rows are seen one by one, so a partition may be of any size.
    """
    known = dict(layers) if layers is not None else {name: run for name, run, _ in LAYERS}

    class LayerOffers:
        @staticmethod
        def analyze(pages: AnalyzeArgument, layer: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(pages.dataType, T.StructType) or not {"url", "html"} <= {f.name for f in pages.dataType.fields}:
                raise ValueError("the table needs columns url and html")
            if not layer.isConstantExpression or layer.value not in known:
                raise ValueError(f"no layer {layer.value!r}; there are {', '.join(known)}")
            own = pages.dataType.fields[0]
            return AnalyzeResult(T.StructType().add(own.name, own.dataType).add("seq", T.IntegerType()).add("field", T.StringType()).add("source", T.StringType()).add("value", T.StringType()))

        def eval(self, page: Row, layer: str) -> Iterator[tuple]:
            try:
                found = known[layer](parse(page["html"]), page["url"] or "")
            except Exception as e:  # one bad page is a note, not an end
                found = [("note", "unavailable", f"Layer {layer} failed: {type(e).__name__}")]
            for i, (field, source, value) in enumerate(found):
                if value is not None and str(value).strip():
                    yield page[0], i, field, source, str(value)

    return LayerOffers


class FirstOwners:
    """A rule across rows: in each partition, in its order, the first row owns the key and the others are findings.

    first_owner(TABLE(rows) PARTITION BY (key) ORDER BY (..), code): the table's first column is the row's id, of any type.
    Only the owner is held, so a key may have any number of rows.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, code: AnalyzeArgument) -> AnalyzeResult:
        own = rows.dataType.fields[0]
        return AnalyzeResult(T.StructType().add(own.name, own.dataType).add("owner", own.dataType).add("code", T.StringType()))

    def __init__(self) -> None:
        self.owner: object = None
        self.seen = False

    def eval(self, row: Row, code: str) -> Iterator[tuple]:
        if self.seen:
            yield row[0], self.owner, code
        else:
            self.seen, self.owner = True, row[0]


def register(spark: SparkSession, layers: dict[str, Layer] | None = None) -> None:
    """layer_offers and first_owner under their names; layers: those of one's own in place of the known ones."""
    spark.udtf.register("layer_offers", udtf(layer_function(layers)))
    spark.udtf.register("first_owner", udtf(FirstOwners))
