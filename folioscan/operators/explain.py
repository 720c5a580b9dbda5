"""Words for the direction in which a feature of text appearance is off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.appearance import FEATURES as NAMES

#: For each feature its name, what more and less of it mean, and where to look.
WORDS = {
    "fg_luminance": ("ink lightness", "the ink is paler", "the ink is deeper", "Hold the letters against those of other cells"),
    "fg_decimal": ("ink color code", "the ink has another hue, later in the color scale", "the ink has another hue, earlier in the color scale", "Sample the color inside a stroke"),
    "bg_luminance": ("paper lightness", "the area behind the letters is paler", "the area behind the letters is shaded", "Sample the area between the letters"),
    "bg_decimal": ("paper color code", "the area behind the letters is tinted, later in the color scale", "the area behind the letters is tinted, earlier in the color scale", "See if the cell lies on a patch of its own"),
    "text_to_bg_ratio": ("ink coverage", "ink fills more of the cell", "ink fills less of the cell", "See if the letters are bolder or closer than elsewhere"),
    "mean_grad": ("average slope at strokes", "strokes end abruptly", "strokes fade out", "Zoom in on the outline of a letter"),
    "std_grad": ("spread of slopes", "abrupt and fading strokes are mixed", "all strokes end alike", "See if some letters of the cell are blurred and others aren't"),
    "q1_grad": ("slope of the faintest quarter", "faint outlines are steeper than usual", "faint outlines are flatter than usual", "Look at thin strokes and serifs"),
    "median_grad": ("usual slope", "the usual outline is steeper", "the usual outline is flatter", "Look at plain upright strokes"),
    "q3_grad": ("slope of the clearest quarter", "clear outlines are steeper than usual", "clear outlines are flatter than usual", "Look at thick strokes"),
    "p95_grad": ("slope of the top twentieth", "the steepest outlines are steeper than usual", "the steepest outlines are flatter than usual", "Look for corners and dots"),
    "p99_grad": ("slope of the top hundredth", "a few outlines are cut very hard", "no outline is cut hard", "Look for corners and dots"),
    "max_grad": ("steepest slope", "one place at least is cut very hard", "no place is cut hard", "Find the single hardest outline"),
    "high_freq": ("energy of small structures", "the cell is full of small structures", "the cell has few small structures", "Look for grain, halos or fringes around letters"),
    "low_freq": ("energy of large structures", "large areas dominate", "large areas are weak", "Step back and see the cell as a patch"),
    "high_to_low": ("small against large structures", "small structures outweigh large areas", "large areas outweigh small structures", "Weigh grain against the overall shape"),
    "lap_mean": ("average bend of brightness", "brightness bends more from pixel to pixel", "brightness bends less from pixel to pixel", "Look at the rims of the letters"),
    "lap_std": ("spread of bends", "rims are of mixed strength", "rims are of one strength", "See if rims differ from letter to letter"),
    "lap_max": ("largest bend", "one rim at least is very strong", "no rim is strong", "Find the strongest rim"),
    "lap_p95": ("bend of the top twentieth", "strong rims are stronger than usual", "strong rims are weaker than usual", "Look at the strongest rims"),
    "lap_zero_crossings": ("number of rims", "there are many rims", "there are few rims", "See if letters have double outlines or holes"),
    "lv_mean": ("average unrest", "the surface is restless", "the surface is calm", "Look at small windows of five pixels"),
    "lv_std": ("spread of unrest", "calm and restless places alternate", "unrest is the same everywhere", "See if only part of the cell is restless"),
    "lv_max": ("greatest unrest", "one place at least is very restless", "no place is restless", "Find the most restless place"),
    "bil_diff_mean": ("loss by smoothing", "smoothing takes much away", "smoothing takes little away", "See the cell before and after smoothing"),
    "bil_edge_pres": ("outlines left by smoothing", "outlines outlast smoothing", "outlines are lost in smoothing", "See the outlines before and after smoothing"),
}


def explain(rows: DataFrame, feature: str, higher: Column) -> DataFrame:
    """rows with name, finding, look_for and a sentence; a feature without words gets a plain hint."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(*[F.lit(w).alias(n) for w, n in zip(x, ("name", "high", "low", "look"), strict=True)]) for kv in WORDS.items() for x in kv])
    w = table[F.col(feature)]
    finding = F.when(higher, w["high"]).otherwise(w["low"])
    plain = F.concat(F.lit("Compare cells by "), F.replace(feature, F.lit("_"), F.lit(" ")))
    sentence = F.when(w.isNull(), plain).otherwise(F.concat(F.lit("**"), w["name"], F.lit("**: in this group "), finding, F.lit(". "), w["look"], F.lit(".")))
    return rows.withColumn("name", w["name"]).withColumn("finding", finding).withColumn("look_for", w["look"]).withColumn("sentence", sentence)
