"""Toolchain of a program from its section names, imports, linker version and rich header.

Variants differ in which marks they trust; each is an ordered list of tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Section names, import parts and bin names.  Section names hold 8 characters,
# so ``.eh_fram`` is the one to test for.
GO_SECTIONS = (".buildid", ".symtab")
DELPHI_SECTIONS = ("CODE", "DATA", ".itext")
GNU_IMPORTS = ("libgcc", "mingw", "msys-")
CRT_IMPORTS = ("ucrtbase", "vcruntime", "api-ms-win-crt")
VARIANTS = ("full", "no_layout", "dotnet", "records", "heuristic", "strings")


def _has(names: str, *wanted: str) -> Column:
    return F.arrays_overlap(F.col(names), F.array(*[F.lit(w) for w in wanted]))


def _part(imports: str, *parts: str) -> Column:
    test = lambda i: F.array_contains(F.array(*[F.contains(i, F.lit(p)) for p in parts]), True)
    return F.exists(imports, test)


def _msvc(version: Column, other: str) -> Column:
    return (F.when(version <= 10, "MSVC<=10").when(version.isin(11, 12), "MSVC 11-12")
            .when(version >= 14, "MSVC 14").otherwise(other))


def _first(tests: Sequence[tuple[Column, Column | str]], otherwise: str = "khac") -> Column:
    out = F.lit(otherwise)
    for cond, value in reversed(tests):
        out = F.when(F.coalesce(cond, F.lit(False)), value).otherwise(out)
    return out


def toolchain_bin(df: DataFrame, variant: str = "full", out: str = "bin") -> DataFrame:
    """Add the bin.  Columns: ``secs``, ``imps`` (lower case), ``linker``, ``rich``; the variants
    ``dotnet``, ``records`` and ``strings`` also read ``dotnet``, ``has_mingw`` / ``has_other_crt`` /
    ``has_msvcrt``, and ``marks`` (compiler strings found in the file)."""
    lk, rich = F.floor("linker"), F.coalesce(F.col("rich"), F.lit(False))
    layout = (lk <= 2) & ~rich & _has("secs", ".bss") & (
        _has("secs", ".CRT") | (_has("secs", ".edata") & _has("secs", ".pdata")))
    msvcrt = F.array_contains("imps", "msvcrt.dll")
    msvc_old = _msvc(lk, "MSVC 14")
    go, delphi = (_has("secs", *GO_SECTIONS), "Go"), (_has("secs", *DELPHI_SECTIONS), "Delphi")
    gnu = _has("secs", ".eh_fram") | _part("imps", *GNU_IMPORTS)
    crt = rich | _part("imps", *CRT_IMPORTS) | (msvcrt & (lk >= 6))
    if variant == "full":
        tests = [go, delphi, (gnu | layout, "GNU/MinGW"), (crt, msvc_old)]
    elif variant == "no_layout":
        tests = [go, delphi, (gnu, "GNU/MinGW"), (crt, msvc_old)]
    elif variant == "dotnet":
        tests = [(F.col("dotnet"), "dotnet"), go, delphi, (gnu | layout, "GNU/MinGW"), (crt, msvc_old)]
    elif variant == "records":
        tests = [go, delphi, (_has("secs", ".eh_fram") | F.col("has_mingw") | layout, "GNU/MinGW"),
                 (rich | F.col("has_other_crt") | (F.col("has_msvcrt") & (lk >= 6)), msvc_old)]
    elif variant == "heuristic":
        go_like = _has("secs", ".symtab") | F.exists("secs", lambda s: F.startswith(s, F.lit(".go")))
        mingw = _part("imps", "libgcc", "libstdc++", "libwinpthread", "mingw", "msys-")
        tests = [(go_like, "Go"), (_has("secs", *DELPHI_SECTIONS, ".didata"), "Delphi"),
                 (_has("secs", ".eh_frame") | mingw | (~rich & msvcrt & (lk < 14)), "GNU/MinGW"),
                 (F.array_contains("imps", "bcrypt.dll") & _part("imps", "api-ms-win-crt"), "Rust?"),
                 (rich | F.array_contains("imps", "ucrtbase.dll") | _part("imps", "vcruntime", "api-ms-win-crt") | msvcrt,
                  _msvc(lk, "MSVC khac"))]
    elif variant == "strings":
        tests = [(_has("marks", "Go build ID", "go1."), "Go"), (_has("marks", "rustc", "/rustc/", "\\.cargo\\"), "Rust"),
                 (_has("marks", "GCC: (") | _has("secs", ".eh_frame"), "GNU/MinGW"),
                 (_has("marks", "Embarcadero", "CodeGear", "Borland") | _has("secs", "CODE"), "Delphi"),
                 (rich | _part("imps", *CRT_IMPORTS, "msvcr"), _msvc(lk, "MSVC khac"))]
    else:
        raise ValueError(f"unknown variant {variant!r}; one of {VARIANTS}")
    return df.withColumn(out, _first(tests))
