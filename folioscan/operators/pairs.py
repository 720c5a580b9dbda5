"""Label and value pairs around colons."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as tx

ROW, DISTANCE, CHAIN = 3.0, 75.0, 20.0


def inline_pairs(cells: DataFrame, compat: bool = False) -> DataFrame:
    """Cells `label: value`, split at the first colon; x positions in proportion to the characters.

    compat: the value's position counts the part up to the colon twice.
    """
    text = F.col("text")
    at = F.instr(text, ":")
    value = F.trim(F.expr("substring(text, instr(text, ':') + 1)"))
    found = cells.filter((at > 1) & (value != "") & ~tx.is_excluded_colon(text)).withColumn("_at", F.instr("text", ":"))
    width, n = F.col("x1") - F.col("x0"), F.length("text")
    lead = F.length(F.expr("substring(text, instr(text, ':') + 1)")) - F.length(F.ltrim(F.expr("substring(text, instr(text, ':') + 1)")))
    label_x1 = F.col("x0") + width * F.col("_at") / n
    start = F.col("_at") + lead + (F.col("_at") if compat else 0)
    value_x0 = F.col("x0") + width * start / n
    return found.withColumn("label", F.trim(F.expr("left(text, instr(text, ':') - 1)"))).withColumn("value", F.trim(F.expr("substring(text, instr(text, ':') + 1)"))).withColumn("spacing", value_x0 - label_x1).drop("_at")


def chained_pairs(cells: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Labels that end with a colon, and the cells that follow them in their row.

    The value begins at the first later cell of the row to the right within DISTANCE and goes on over later cells until
    one has a colon, leaves the row or lies more than CHAIN away; cells not to the right are passed over.
    """

    kinds = dict(cells.dtypes)
    used = [ident, "text", "x0", "x1", "y0"]

    def kernel(table: pa.Table) -> pa.Table:
        rows = table.select(used).sort_by(ident)
        ids, texts = rows[ident].to_pylist(), rows["text"].to_pylist()
        x0, x1, y0 = (rows[c].to_numpy().tolist() for c in ("x0", "x1", "y0"))  # an unknown place is NaN, near nothing
        out, n = [], len(ids)
        for i in [k for k, text in enumerate(texts) if text.rstrip().endswith(":")]:
            j = next((k for k in range(i + 1, n) if abs(y0[k] - y0[i]) <= ROW and x0[k] > x0[i] and x0[k] - x1[i] <= DISTANCE and ":" not in texts[k]), None)
            if j is None:
                continue
            value, last = [texts[j]], x1[j]
            for k in range(j + 1, n):
                if ":" in texts[k] or abs(y0[k] - y0[i]) > ROW or x0[k] - last > CHAIN:
                    break
                if x0[k] < last:
                    continue
                value.append(texts[k])
                last = x1[k]
            out.append((ids[i], texts[i].rstrip()[:-1], " ".join(value), x0[j] - x1[i], last))
        found = zip(*out, strict=True) if out else [[]] * 5
        types = [table.schema.field(ident).type, pa.string(), pa.string(), pa.float64(), pa.float64()]
        page = [pa.repeat(table.column(k)[0], len(out)) for k in keys]
        return pa.Table.from_arrays([*page, *(pa.array(c, t) for c, t in zip(found, types, strict=True))], [*keys, ident, "label", "value", "spacing", "value_x1"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, ident]) + ", label string, value string, spacing double, value_x1 double"
    return cells.select(*dict.fromkeys([*keys, *used])).groupBy(*keys).applyInArrow(kernel, schema)
