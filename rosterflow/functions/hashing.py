"""Integer companions of string ids, and sort keys of names."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def person_hash(external_id: Column) -> Column:
    """The last eight bytes of the MD5 digest, little-endian, as a signed bigint with the same bits."""
    digest = F.md5(external_id)
    flipped = F.concat(*[F.substring(digest, 31 - 2 * i, 2) for i in range(8)])
    return F.conv(flipped, 16, -10).cast("bigint")


def _plain_letters() -> tuple[str, str]:
    """(letters with marks, their letters): all that decompose into one letter and marks; marks of their own have no letter and go."""
    pairs, marks = [], []
    for c in map(chr, range(0x80, 0x3000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if not bare:
            marks.append(c)
        elif bare != c and len(bare) == 1:
            pairs.append((c, bare))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(x for _, x in pairs)


MARKED, PLAIN = _plain_letters()


def name_key(last: Column, first: Column, start: int = 1) -> Column:
    """Sixteen characters of LAST FIRST without accents, upper case, padded with blanks: their order is alphabetical."""
    name = F.upper(F.translate(F.concat_ws(" ", last, first), MARKED, PLAIN))
    return F.rpad(F.substring(name, start, 16), 16, " ")


def packed(key: Column, start: int) -> Column:
    """Eight characters of ``key`` from ``start`` (1-based) as an unsigned big-endian number in the bits of a bigint."""
    out = F.lit(0).cast("bigint")
    for i in range(start, start + 8):
        byte = F.least(F.ascii(F.substring(key, i, 1)), F.lit(255)).cast("bigint")
        out = F.shiftleft(out, 8).bitwiseOR(byte)
    return out
