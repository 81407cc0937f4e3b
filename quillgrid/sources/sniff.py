"""What a delimited file looks like, from its first bytes. Runs inside tasks."""

import codecs
import csv
from dataclasses import dataclass

# --- Fixed values ------------------------------------------------------------
SNIFF_BYTES = 65_536
DELIMITERS = ",;\t|"
# -----------------------------------------------------------------------------

_MARKS = (
    (codecs.BOM_UTF8, "UTF-8"),
    (codecs.BOM_UTF16_LE, "UTF-16LE"),
    (codecs.BOM_UTF16_BE, "UTF-16BE"),
)


@dataclass
class Layout:
    encoding: str
    delimiter: str
    line_end: str
    header: list[str]


def encoding_of(head: bytes) -> str:
    for mark, name in _MARKS:
        if head.startswith(mark):
            return name
    if b"\0" in head:  # UTF-16 without a mark: plain letters leave every other byte empty
        return "UTF-16LE" if head[1::2].count(0) >= head[0::2].count(0) else "UTF-16BE"
    try:
        # A character cut at the end of the sample is not an error.
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def delimiter_of(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def layout_of(head: bytes) -> Layout:
    encoding = encoding_of(head)
    text = head.decode(encoding, errors="replace").lstrip("﻿")
    delimiter = delimiter_of(text)
    line_end = "\r" if "\r" in text and "\n" not in text else "\n"
    lines = (line for line in text.splitlines(keepends=True) if line.strip())
    return Layout(encoding, delimiter, line_end, next(csv.reader(lines, delimiter=delimiter), []))
