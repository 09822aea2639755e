"""A few small bibliographies as layout lines, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources.files import LAYOUT


def _numeric(n: int) -> list[str]:
    return [f"[{k}] A. Author{chr(96 + k)}, B. Writer. On the theory of item number {k}. Journal of Things {k}:{k * 7}, {1990 + k}." for k in range(1, n + 1)]


def _indented(n: int) -> list[tuple[str, float]]:
    out = []
    for k in range(1, n + 1):
        out.append((f"Surname{chr(96 + k)}, A. and Other, B. ({2000 + k}). A study of the matter", 50.0))
        out.append((f"of number {k} in some depth. Annals of Matter {k}(2), pp. {k * 10}.", 70.0))
    return out


def rows() -> list[tuple]:
    """(doc, pos, text, x0, y0, x1, y1, font_size, page, col)."""
    docs: dict[str, list[tuple[str, float, int]]] = {}
    body = [("An Introduction to Things", 50.0, 1), ("Some text with a marker [1] and [2].", 50.0, 1), ("Running head", 50.0, 1), ("17", 300.0, 1)]
    docs["numeric"] = [*body, ("References", 50.0, 2), *[(t, 50.0, 2) for t in _numeric(8)], ("Running head", 50.0, 2), ("18", 300.0, 2)]
    docs["indent"] = [*body, ("5. Bibliography", 50.0, 2), *[(t, x, 2) for t, x in _indented(7)], ("Appendix A", 50.0, 2), ("More text here.", 50.0, 2)]
    docs["gap"] = [*body, ("References", 50.0, 2), *[(t, 50.0, 2) for i, t in enumerate(_numeric(8)) if i != 3], ("author@example.org", 50.0, 2)]
    docs["prose"] = [*body, ("References", 50.0, 2), *[(f"this line of prose number {'x' * k} goes on without a key", 50.0, 2) for k in range(1, 9)]]
    return [(doc, i, t, x, 10.0 * i, x + 200.0, 10.0 * i + 8.0, 10.0, page, None) for doc, lines in sorted(docs.items()) for i, (t, x, page) in enumerate(lines, 1)]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), LAYOUT)
