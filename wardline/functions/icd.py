"""ICD-10 codes as Column expressions: normal form, chapter, groups, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chapters of ICD-10 by their ranges of categories, and the category prefixes of chronic condition groups.
CHAPTERS = {
    "A00-B99": "Infectious and parasitic diseases",
    "C00-D49": "Neoplasms",
    "D50-D89": "Blood and immune mechanism disorders",
    "E00-E89": "Endocrine, nutritional and metabolic diseases",
    "F01-F99": "Mental, behavioral and neurodevelopmental disorders",
    "G00-G99": "Nervous system diseases",
    "H00-H59": "Eye and adnexa diseases",
    "H60-H95": "Ear and mastoid process diseases",
    "I00-I99": "Circulatory system diseases",
    "J00-J99": "Respiratory system diseases",
    "K00-K95": "Digestive system diseases",
    "L00-L99": "Skin and subcutaneous tissue diseases",
    "M00-M99": "Musculoskeletal system and connective tissue diseases",
    "N00-N99": "Genitourinary system diseases",
    "O00-O9A": "Pregnancy, childbirth and the puerperium",
    "P00-P96": "Certain conditions originating in the perinatal period",
    "Q00-Q99": "Congenital malformations, deformations and chromosomal abnormalities",
    "R00-R99": "Symptoms, signs and abnormal clinical and laboratory findings",
    "S00-T88": "Injury, poisoning and certain other consequences of external causes",
    "V00-Y99": "External causes of morbidity",
    "Z00-Z99": "Factors influencing health status and contact with health services",
}
GROUPS = {
    "hypertension": ["I10", "I11", "I12", "I13", "I15"],
    "diabetes": ["E08", "E09", "E10", "E11", "E13"],
    "copd": ["J40", "J41", "J42", "J43", "J44"],
    "asthma": ["J45"],
    "heart_failure": ["I50"],
    "ischemic_heart": ["I20", "I21", "I22", "I23", "I24", "I25"],
    "kidney_disease": ["N18"],
    "liver_disease": ["K70", "K71", "K72", "K73", "K74", "K75", "K76", "K77"],
    "cancer": [
        "C00", "C01", "C02", "C03", "C04", "C05", "C06", "C07", "C08", "C09", "C10", "C11", "C12", "C13", "C14", "C15",
        "C16", "C17", "C18", "C19", "C20", "C21", "C22", "C23", "C24", "C25", "C26", "C30", "C31", "C32", "C33", "C34",
        "C37", "C38", "C39", "C40", "C41", "C43", "C44", "C45", "C46", "C47", "C48", "C49", "C50", "C51", "C52", "C53",
        "C54", "C55", "C56", "C57", "C58", "C60", "C61", "C62", "C63", "C64", "C65", "C66", "C67", "C68", "C69", "C70",
        "C71", "C72", "C73", "C74", "C75", "C76", "C81", "C82", "C83", "C84", "C85", "C86", "C88", "C90", "C91", "C92",
        "C93", "C94", "C95", "D00", "D01", "D02", "D03", "D04", "D05", "D06", "D07", "D09",
    ],
    "depression": ["F32", "F33"],
    "dementia": ["F01", "F02", "F03", "G30"],
    "stroke": ["I60", "I61", "I62", "I63", "I65", "I66", "I67", "I69"],
    "obesity": ["E66"],
    "substance_abuse": ["F10", "F11", "F12", "F13", "F14", "F15", "F16", "F17", "F18", "F19"],
}


def normal(code: Column, dot: bool = False, longest: int | None = None) -> Column:
    """Trimmed and upper-cased, without dots unless ``dot``; empty if it isn't a letter and digits (null stays empty)."""
    c = F.upper(F.trim(code))
    valid = F.coalesce((c if dot else F.replace(c, F.lit("."), F.lit(""))).rlike(r"^[A-Z][0-9]+(\.[0-9]+)?$"), F.lit(False))
    plain = F.replace(c, F.lit("."), F.lit(""))
    if longest:
        plain = F.substring(plain, 1, longest)
    made = F.when(F.contains(c, F.lit(".")) & (F.length(plain) > 3), F.concat(F.substring(plain, 1, 3), F.lit("."), F.substring(plain, 4, 100))).otherwise(plain) if dot else plain
    return F.when(valid, made).otherwise("")


def category(code: Column) -> Column:
    return F.rpad(F.substring(F.replace(code, F.lit("."), F.lit("")), 1, 3), 3, "0")


def chapter_of(three: Column) -> Column:
    """The range of the chapter that a category (``category``) is in; null for none. The ranges are in order, so they are found by
    halves: five comparisons a row."""
    names = list(CHAPTERS)
    low = [n.split("-")[0] for n in names]
    high = [n.split("-")[1].replace("9A", "99") for n in names]

    def half(a: int, b: int) -> Column:
        if b - a == 1:
            return F.when((three >= low[a]) & (three <= high[a]), names[a])
        m = (a + b) // 2
        return F.when(three < low[m], half(a, m)).otherwise(half(m, b))

    return half(0, len(names))


def chapter(code: Column) -> Column:
    """The range of the chapter that a normal code is in; null for none."""
    return F.when(F.length(code) > 0, chapter_of(category(code)))


def valid(code: Column) -> Column:
    return code.rlike(r"^[A-Z][0-9]{2}(\.[0-9]{1,4})?$")


def starts_with_any(code: Column, prefixes: list[str]) -> Column:
    """Empty prefixes match nothing."""
    plain = [p.strip().upper().replace(".", "") for p in prefixes]
    tests = [F.startswith(code, F.lit(p)) for p in plain if p]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
