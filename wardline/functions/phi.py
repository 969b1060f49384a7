"""What personal health information looks like: patterns of content, and names of columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of personal data in text, as regular expressions.
PATTERNS = {
    "name": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "phone": r"\b(\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "address": r"\b\d+\s+[A-Za-z\s]+,\s+[A-Za-z\s]+,\s+[A-Z]{2}\s+\d{5}(-\d{4})?\b",
    "date": r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    "mrn": r"\b(MRN|mrn|Medical Record Number|medical record number)[:# ]?\s*\d+\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "url": r'\bhttps?://[^\s<>"]+|www\.[^\s<>"]+\b',
    "zipcode": r"\b\d{5}(-\d{4})?\b",
}

# Parts of column names that suggest personal data, whatever their case.
COLUMN_PATTERNS = (
    "name", "address", "birth", "dob", "phone", "email", "ssn", "social", "mrn", "medical.?record", "patient.?id", "zip", "postal", "city",
    "state", "date", "age", "identifier", "license", "account", "url", "ip.?address", "device",
)
# Parts of column names by what they hold, for the choice of a mask and for k-anonymity.
KINDS = {
    "age": (r"^age$", r"age[_\s]", r"[_\s]age$", r"patient[_\s]age", r"age[_\s]years"),
    "address": ("address", "street", "city", "state", "zip", "postal"),
    "name": ("name", r"first[_\s]name", r"last[_\s]name", r"middle[_\s]name", r"patient[_\s]name"),
    "contact": ("phone", "email", "fax", "contact", "mobile", "cell"),
    "id": ("id$", "identifier", "number", "code", "key"),
    "mrn": ("mrn", r"medical[_\s]record", r"record[_\s]number"),
    "ssn": ("ssn", r"social[_\s]security", r"tax[_\s]id"),
    "device": (r"device[_\s]id", r"serial[_\s]number", "imei", "uuid"),
}
INDICATORS = {
    "name": ("name", "first", "last", "middle"),
    "address": ("address", "street", "city", "state", "zip", "postal"),
    "date": ("date", "dob", "birth", "admission", "discharge"),
    "id": ("id", "identifier", "mrn", "ssn", "social", "account"),
    "contact": ("phone", "email", "fax", "contact", "mobile", "cell"),
}
QUASI = ("age", "gender", "race", "ethnicity")


def instances(text: Column, kind: str) -> Column:
    """How often a kind of personal data occurs in a text; 0 in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[kind])), F.lit(0))


def masked(text: Column, kinds=tuple(PATTERNS), mark: str = "[REDACTED]") -> Column:
    """The text with every instance replaced."""
    for k in kinds:
        text = F.regexp_replace(text, PATTERNS[k], mark)
    return text


def suspicious(column: str) -> bool:
    return any(re.search(p, column, re.IGNORECASE) for p in COLUMN_PATTERNS)


def looks_like(column: str, kind: str) -> bool:
    return any(re.search(p, column, re.IGNORECASE) for p in KINDS[kind])


def indicated(column: str) -> list[str]:
    return [kind for kind, parts in INDICATORS.items() if any(p in column.lower() for p in parts)]
