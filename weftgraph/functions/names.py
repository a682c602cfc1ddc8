"""Names of modules and packages as column expressions: from paths, from relative imports, and what is external."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes whose members go by their upper-case stem, system utilities and prefixes of vendor programs.
MEMBER_SUFFIXES = ("cbl", "cob", "cobol", "cpy", "jcl", "prc", "proc", "asm", "hlasm", "mac", "bms", "csd")
UTILITIES = ("IDCAMS", "IEBGENER", "IEBCOPY", "IEFBR14", "SORT", "DFSORT", "SYNCSORT", "ICETOOL", "IKJEFT01", "IKJEFT1B", "IEBUPDTE", "IEWL", "DFSRRC00", "ADRDSSU")
PREFIXES = ("DFH", "DSN", "CEE", "IGZ", "EZA", "IXG", "CBL", "ILBO", "MQ")
#: Top-level modules that the languages bring along (fixed values, the common ones).
STANDARD = "abc argparse ast asyncio base64 collections contextlib csv dataclasses datetime decimal enum functools glob hashlib io itertools json logging math os pathlib random re shutil sqlite3 string subprocess sys tempfile threading time typing unittest urllib uuid fs http https path util".split()


def module_name(path: Column | str) -> Column:
    """The module that a file is: the upper-case stem of a mainframe member, else the dotted path without suffix, ``__init__`` and the folder alone."""
    path = F.col(path) if isinstance(path, str) else path
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")
    dotted = F.regexp_replace(F.regexp_replace(dotted, r"(^|\.)__init__$", ""), r"^\.+", "")
    return F.when(F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*MEMBER_SUFFIXES), F.upper(stem)).otherwise(dotted)


def python_import(module: Column | str, wanted: Column | str, is_package: Column) -> Column:
    """The module that an import of ``wanted`` in ``module`` means: each leading dot beyond the first goes up one package; absolute names stay."""
    module, wanted = (F.col(c) if isinstance(c, str) else c for c in (module, wanted))
    dots = F.length(F.regexp_extract(wanted, r"^(\.*)", 1))
    parts = F.split(module, r"\.")
    kept = F.greatest(F.lit(0), F.size(parts) - dots + F.when(is_package, 1).otherwise(0))
    rest = F.regexp_replace(wanted, r"^\.+", "")
    joined = F.array_join(F.concat(F.slice(parts, F.lit(1), kept), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest))), ".")
    return F.when(dots == 0, wanted).otherwise(joined)


def javascript_import(module: Column | str, wanted: Column | str) -> Column:
    """The module that ``wanted`` means in ``module``: ``./`` and ``../`` are followed, suffixes and a last ``index`` taken off; other names stay."""
    module, wanted = (F.col(c) if isinstance(c, str) else c for c in (module, wanted))
    lead = F.regexp_extract(wanted, r"^((?:\.\.?/)+|\.\.?$)", 1)
    ups = F.length(F.regexp_replace(F.regexp_replace(lead, r"\.\.(?:/|$)", "^"), r"[./]", ""))
    parts = F.split(module, r"\.")
    kept = F.greatest(F.lit(0), F.size(parts) - 1 - ups)
    rest = F.regexp_replace(F.regexp_replace(F.substring(wanted, F.length(lead) + 1, F.length(wanted)), r"\.(js|jsx|ts|tsx|mjs|cjs)$", ""), "/", ".")
    joined = F.array_join(F.concat(F.slice(parts, F.lit(1), kept), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest))), ".")
    return F.when(lead == "", wanted).otherwise(F.regexp_replace(joined, r"(^|\.)index$", ""))


def is_external_name(name: Column | str) -> Column:
    """Is a program a system utility or one of a vendor's, by its name?"""
    name = F.upper(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    return name.isin(*UTILITIES) | name.rlike("^(" + "|".join(PREFIXES) + ")")


def merge_attributes(first: Column | str, second: Column | str) -> Column:
    """Two maps as one: the second's values win, null values are left out, a null map is empty."""
    first, second = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.create_map().cast("map<string,string>")) for c in (first, second))
    known = F.map_filter(second, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(first, lambda k, v: v.isNotNull() & ~F.map_contains_key(known, k)), known)


def truncated(text: Column | str, length: int = 200) -> Column:
    """A cell as it is shown: at most ``length`` characters, and an ellipsis for what is cut off."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)
