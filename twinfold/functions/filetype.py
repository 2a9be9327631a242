"""File types by the magic numbers at the start of their content.

The entries are a choice of this engine, from the public format specifications.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: upper-case hexadecimal magic numbers and the types they mean
MAGIC = {
    "89504E470D0A1A0A": "png",
    "FFD8FF": "jpg",
    "474946383761": "gif",
    "474946383961": "gif",
    "424D": "bmp",
    "49492A00": "tif",
    "4D4D002A": "tif",
    "25504446": "pdf",
    "504B0304": "zip",
    "1F8B": "gz",
    "425A68": "bz2",
    "FD377A585A00": "xz",
    "28B52FFD": "zst",
    "377ABCAF271C": "7z",
    "526172211A07": "rar",
    "7F454C46": "elf",
    "4D5A": "exe",
    "CAFEBABE": "class",
    "0061736D": "wasm",
    "494433": "mp3",
    "4F676753": "ogg",
    "664C6143": "flac",
    "50415231": "parquet",
    "4F7263": "orc",
    "53514C69746520666F726D6174203300": "sqlite",
    "25215053": "ps",
    "7B5C727466": "rtf",
    "3C3F786D6C": "xml",
    "3C21444F4354595045": "html",
    "3C68746D6C": "html",
}


def file_type(content: Column) -> Column:
    """The type whose magic number the content begins with; the longest wins.

    Null without a match. Only the first bytes are looked at.
    """
    longest = max(map(len, MAGIC)) // 2
    start = F.hex(F.substring(content.cast("binary"), 1, longest))
    out = F.lit(None).cast("string")
    for magic, kind in sorted(MAGIC.items(), key=lambda x: len(x[0])):
        out = F.when(start.startswith(magic), kind).otherwise(out)
    return out


def magic_map() -> Column:
    """The map itself, from magic number to type."""
    return F.create_map(*[F.lit(x) for pair in MAGIC.items() for x in pair])
