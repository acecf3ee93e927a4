"""Edit parameters: documents of sliders to three normalised groups, masks and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import python_float
from .render import bound

# Slider names of the three groups, and the prompts' texts.
LIGHT = ("Exposure2012", "Contrast2012", "Highlights2012", "Shadows2012", "Whites2012", "Blacks2012", "ParametricShadows", "ParametricDarks", "ParametricLights", "ParametricHighlights")
COLOR_TEMPERATURE = ("IncrementalTemperature", "IncrementalTint", "Vibrance", "Saturation")
MIXER = (
    "HueAdjustmentRed", "HueAdjustmentOrange", "HueAdjustmentYellow", "HueAdjustmentGreen", "HueAdjustmentAqua", "HueAdjustmentBlue", "HueAdjustmentPurple", "HueAdjustmentMagenta",
    "SaturationAdjustmentRed", "SaturationAdjustmentOrange", "SaturationAdjustmentYellow", "SaturationAdjustmentGreen", "SaturationAdjustmentAqua", "SaturationAdjustmentBlue", "SaturationAdjustmentPurple", "SaturationAdjustmentMagenta",
    "LuminanceAdjustmentRed", "LuminanceAdjustmentOrange", "LuminanceAdjustmentYellow", "LuminanceAdjustmentGreen", "LuminanceAdjustmentAqua", "LuminanceAdjustmentBlue", "LuminanceAdjustmentPurple", "LuminanceAdjustmentMagenta",
)
GROUPS = {"Light Adjustment": LIGHT, "Color and Temperature Adjustment": COLOR_TEMPERATURE, "Specific Color Adjustment": MIXER}
AUTO_PROMPT = "<Auto_Retouch_Task>\nNow, you are acting as a Retouch Agent. When I provide an image, please state the problems found in the image (from 3 aspects: lighting, global_color, specific color), and give the solution and retouch tokens."
STYLE_PROMPT = "<Style_Retouch_Task>\nNow, you are acting as a Retouch Agent. I will provide an image and an instruction, please give me a retouch plan and retouch tokens.\n Instruction: "
PARAM_PROMPT = "<Professional_Retouch_Task>\nNow, you are acting as a Retouch Agent. I will provide an image and an professional instruction (plain text description or retouch operator parameters range from -1.0 to 1.0), please give me a retouch plan and retouch tokens.\n Instruction: "
QUESTIONS = (
    ("content", "Please describe the framing and content of this image."),
    ("content", "Can you provide a description of how this image is composed and what it depicts?"),
    ("content", "Could you outline both the structure and the subject matter of the photograph?"),
    ("content", "Please give an account of the image’s framing as well as its depicted elements."),
    ("content", "Tell me about the composition and the narrative content captured in this image."),
    ("retouch", "Could you help me to retouch this image?"),
    ("retouch", "Can you assist with retouching this image for me?"),
    ("retouch", "Would you be able to help retouch this picture?"),
    ("retouch", "Could you do me a favor and retouch this image?"),
    ("retouch", "Is it possible for you to help with retouching this picture?"),
    ("retouch", "Can you lend a hand in retouching this image?"),
    ("retouch", "Would you help me out by retouching this picture?"),
    ("retouch", "Could you assist me in retouching this image?"),
    ("retouch", "Is there a way you could help retouch this picture for me?"),
    ("retouch", "Can you help me get this image retouched?"),
    ("retouch", "Would you be willing to help with retouching this picture?"),
)
SPECIAL_TOKENS = {
    "retouch": ("<retouch_light>", "<retouch_color&temp>", "<retouch_colormixer>"),
    "problem": ("<problem_light_start>", "<problem_globalcolor_start>", "<problem_specificcolor_start>", "<problem_light_end>", "<problem_globalcolor_end>", "<problem_specificcolor_end>"),
    "plan": ("<plan_light_start>", "<plan_globalcolor_start>", "<plan_specificcolor_start>", "<plan_light_end>", "<plan_globalcolor_end>", "<plan_specificcolor_end>"),
    "task": ("<Auto_Retouch_Task>", "<Style_Retouch_Task>", "<Professional_Retouch_Task>"),
}
DOCUMENT = "map<string, struct<value: double>>"


def rounded(x: Column, digits: int) -> Column:
    """A double rounded on its binary value, as Python's ``round``: to the nearest decimal, true halves to even.

    Of the decimals k and k + 1 around x * 10 ** digits the nearest is told by the sign of x * 2 * 10 ** digits - (2 k + 1), which is found without error:
    x is split into two halves whose products are exact.  Exact for up to 3 digits; doubles beyond 2 ** 40 have too few binary places to change.
    """
    scale = float(10**digits)

    def nearest(s: Column) -> Column:
        v, k, high = s["v"], s["k"], s["high"]
        off = (high * (2 * scale) - (2 * k + 1)) + (v - high) * (2 * scale)
        whole = k + F.when((off > 0) | ((off == 0) & (k % 2 != 0)), 1.0).otherwise(0.0)
        # a product with zero keeps the sign
        return F.when((F.abs(v) >= float(2**40)) | (v == 0), v).when(whole == 0, v * 0.0).otherwise(whole / scale)

    # high: the upper 26 bits
    parts = lambda v: F.struct(v.alias("v"), F.floor(v * scale).cast("double").alias("k"), (v * 134217729.0 - (v * 134217729.0 - v)).alias("high"))
    return bound(bound(x, parts), nearest)


def scaled(value: Column) -> Column:
    """A slider's value over 100, to three decimals."""
    return rounded(value / 100.0, 3)


def _names(group: str) -> Column:
    return F.array(*(F.lit(n) for n in GROUPS[group]))


def normalised(doc: Column) -> dict[str, Column]:
    """Group name to array of its sliders' values in order: unknown ones are dropped, missing ones are 0. ``doc`` is a DOCUMENT."""
    return {group: F.transform(_names(group), lambda n: F.coalesce(scaled(F.element_at(doc, n)["value"]), F.lit(0.0))) for group in GROUPS}


def all_zero(group: Column) -> Column:
    """True if no slider of the group is beyond 0.0001."""
    return F.forall(group, lambda v: F.abs(v) <= 0.0001)


def control_mask(doc: Column) -> Column:
    """array<double> of 1 for each group with an edit, else 0."""
    return F.array(*(F.when(all_zero(group), 0.0).otherwise(1.0) for group in normalised(doc).values()))


def slider_rows(docs: DataFrame, key: str, doc: str = "params") -> DataFrame:
    """(key, group_name, slider, value) of every known slider of every document."""
    def of(group: str, values: Column) -> Column:
        return F.zip_with(_names(group), values, lambda n, v: F.struct(F.lit(group).alias("group_name"), n.alias("slider"), v.alias("value")))

    return docs.select(key, F.inline(F.concat(*(of(g, values) for g, values in normalised(F.col(doc)).items()))))


def group_text(group: Column, name: str) -> Column:
    """A group's values as Python prints a dict."""
    cells = F.zip_with(_names(name), group, lambda n, v: F.concat(F.lit("'"), n, F.lit("': "), python_float(v)))
    return F.concat(F.lit("{"), F.array_join(cells, ", "), F.lit("}"))


def param_prompt(doc: Column) -> Column:
    """The prompt of a parameter document; it has no image mark."""
    groups = normalised(doc)
    body = F.concat_ws(", ", *(F.concat(F.lit(f"'{g}': "), group_text(groups[g], g)) for g in GROUPS))
    return F.concat(F.lit(PARAM_PROMPT + "{"), body, F.lit("}"))


def style_prompt(instruction: Column) -> Column:
    return F.concat(F.lit("<image>\n" + STYLE_PROMPT), instruction)


#: What a run can be asked for.
MODES = ("auto", "style", "param")


def checked_mode(mode: Column) -> Column:
    """The mode, if it is one; others fail the plan."""
    return F.when(mode.isin(*MODES), mode).otherwise(F.raise_error(F.concat(F.lit("no such mode: "), F.coalesce(mode, F.lit("null")))))
