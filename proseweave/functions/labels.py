"""Codes and flags of the simulation design (temperature band, paraphrase kind and position)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts and cuts.
BANDS = ("low_temperature", "medium_temperature", "high_temperature")
BAND_CUTS = (2.0, 4.0)
DISPLAY_BAND_CUTS = (2.0, 3.0)
KIND_CODES = {"absent": 0, "[]": 0, "['close']": 1, "['distant']": 2}
TREATMENT_0 = ("low_temperature_with_no_paraphrase",)
TREATMENT_1 = ("high_temperature_with_paraphrase", "medium_temperature_with_paraphrase")


def kind_code(kind: Column) -> Column:
    """0 none, 1 close, 2 distant; an unknown numeric text keeps its number, other text is -1."""
    out = F.when(kind.isin([k for k, v in KIND_CODES.items() if v == 0]), F.lit(0))
    for text, code in KIND_CODES.items():
        if code:
            out = out.when(kind == text, F.lit(code))
    return out.otherwise(F.coalesce(kind.try_cast("int"), F.lit(-1)))


def band_code(temperature: Column, cuts: tuple[float, float] = BAND_CUTS) -> Column:
    return F.when(temperature < cuts[0], 0).when(temperature < cuts[1], 1).otherwise(2)


def band_name(temperature: Column, cuts: tuple[float, float] = BAND_CUTS, names: tuple = BANDS) -> Column:
    return (
        F.when(temperature < cuts[0], names[0]).when(temperature < cuts[1], names[1]).otherwise(names[2])
    )


def paraphrase_name(flag: Column) -> Column:
    return F.when(flag == 0, "no_paraphrase").otherwise("paraphrase")


def combined_label(band: Column, para: Column) -> Column:
    return F.concat(band, F.lit("_with_"), para)


def label_band(label: Column) -> Column:
    return F.element_at(F.split(label, "_"), 1)


def label_paraphrase(label: Column) -> Column:
    return F.when(F.contains(label, F.lit("with_paraphrase")), "with_paraphrase").otherwise(
        "with_no_paraphrase"
    )


def treatment(label: Column) -> Column:
    return F.when(label.isin(*TREATMENT_0), 0).when(label.isin(*TREATMENT_1), 1).otherwise(-1)


def is_pair(idx: Column) -> Column:
    return F.size(idx) == 2


def first_flag(idx: Column) -> Column:
    """1 when the paraphrased sentence is sentence 1; null without a pair."""
    return F.when(is_pair(idx), (F.try_element_at(idx, F.lit(1)) == 1).cast("int"))


def consecutive_flag(idx: Column) -> Column:
    src, dst = F.try_element_at(idx, F.lit(1)), F.try_element_at(idx, F.lit(2))
    return F.when(is_pair(idx), (dst - src == 1).cast("int"))


def short_flag(idx: Column, sents: Column) -> Column:
    """1 when the sentence before the source has fewer than five words. Source 0 looks at the last
    sentence (the position wraps), a position outside the text gives 0."""
    before = F.try_element_at(idx, F.lit(1)) - 1
    at = F.when(before >= 0, before + 1).when(before + F.size(sents) >= 0, before)
    words = F.size(F.split(F.try_element_at(sents, at), " ", -1))
    return F.when(F.size(idx) > 0, F.coalesce((words < 5).cast("int"), F.lit(0))).otherwise(F.lit(0))


def end_flag(idx: Column, n: Column) -> Column:
    src = F.try_element_at(idx, F.lit(1))
    return F.when(is_pair(idx) & (src >= n - 2), 1).otherwise(0)


def lookup(value: Column, mapping: dict, keep_unknown: bool = False) -> Column:
    """Dictionary lookup; unknown values become null, or stay when ``keep_unknown``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, value) if keep_unknown else found
