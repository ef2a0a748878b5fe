"""Path, name and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that may surround a value.
BLANKS = " \t\r\n\f\x0b"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """The value without surrounding blanks of any kind."""
    return F.btrim(col(c), F.lit(BLANKS))


def plain_path(c: Column | str) -> Column:
    """`/` as separator, none doubled, no leading `./`, no blanks around; null stays null."""
    slashed = F.translate(trimmed(c), "\\", "/")
    return F.regexp_replace(F.regexp_replace(slashed, "/{2,}", "/"), r"^(\./)+", "")


def plain_crop_id(c: Column | str) -> Column:
    """Plain form of `path#rank`; an id without `#` is a bare path."""
    c = col(c)
    rank = F.substring_index(c, "#", -1)
    path = F.substr(c, F.lit(1), F.length(c) - F.length(rank) - 1)
    return F.when(F.contains(c, F.lit("#")), F.concat(plain_path(path), F.lit("#"), trimmed(rank))).otherwise(plain_path(c))


def crop_key(path: Column | str, rank: Column | str) -> Column:
    """`path#rank` of a plain path; null if either part is."""
    return F.concat(plain_path(path), F.lit("#"), trimmed(col(rank).cast("string")))


def board_of(board: Column | str, path: Column | str) -> Column:
    """The board, or where it is null the second segment of the plain path."""
    second = F.split_part(plain_path(path), F.lit("/"), F.lit(2))
    return F.coalesce(col(board), F.when(second != "", second))


def file_name(c: Column | str) -> Column:
    """Last segment of a path written with either separator."""
    return F.substring_index(F.translate(col(c), "\\", "/"), "/", -1)


def folder(c: Column | str) -> Column:
    """Everything before the last `/`, or `.` for a bare name."""
    f = F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1)
    return F.when(f == "", ".").otherwise(f)


def stem(c: Column | str) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column | str) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(c), r".(\.[^.]*)$", 1))


def component_hint(name_stem: Column | str) -> Column:
    """`C<n>` for a stem ending in `_C<n>`, else an empty string."""
    n = F.regexp_extract(col(name_stem), r"_C(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("C"), n)).otherwise(F.lit(""))


def component_number(hint: Column | str, image_name: Column | str) -> Column:
    """Digits of the first number in the hint, else of a `_C<n>` that ends the stem; no leading zeros; null if none."""
    digits = F.coalesce(
        F.nullif(F.regexp_extract(col(hint), r"(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(stem(image_name), r"_C(\d+)$", 1), F.lit("")),
    )
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def capture_timestamp(name_stem: Column | str) -> Column:
    """ISO text of a stem `WIN_YYYYMMDD_HH_MM_SS_Pro`; anything after or around it gives null."""
    pattern = r"^WIN_(\d{4})(\d{2})(\d{2})_(\d{2})_(\d{2})_(\d{2})_Pro$"
    c = col(name_stem)
    return F.when(c.rlike(pattern), F.regexp_replace(c, pattern, "$1-$2-$3T$4:$5:$6"))


def path_info(parts: Column) -> Column:
    """Struct of board, package, viewpoint, setup from the folder segments around the first viewpoint segment.

    The first segment like `V2` or `V2.1` is the viewpoint, the two before it package and board, the next one
    the setup if it reads `Setup<n>`. Without a viewpoint segment every field is null.
    """
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^V\d+(\.\d+)?$")), F.lit(True))
    pick = lambda k: F.when((at > 0) & (at + k > 0), F.try_element_at(parts, (at + k).cast("int")))
    setup = pick(1)
    return F.struct(
        pick(-2).alias("board"), pick(-1).alias("package"), pick(0).alias("viewpoint"),
        F.when(setup.rlike(r"^Setup\d+$"), setup).alias("setup"),
    )


#: Task of a viewpoint, packages in scope, light direction of a viewpoint.
TASKS = {"V1": "placement", "V2": "joint", "V2.1": "joint"}
IN_SCOPE = ("R0603", "R0805", "R1206", "C0805")
LIGHT = {"V2": "bottom_to_top", "V2.1": "top_to_bottom"}


def lookup(c: Column | str, table: dict[str, str]) -> Column:
    """Value of a small fixed table, null for keys it lacks."""
    c = col(c)
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out if out is not None else F.lit(None).cast("string")


def file_safe_id(board, package, view, path, rank) -> Column:
    """`board_package_view_stem_rank` with the dot of the view replaced."""
    return F.concat_ws("_", col(board), col(package), F.replace(col(view), F.lit("."), F.lit("_")), stem(path), col(rank).cast("string"))


def short_label(name_stem: Column | str, hint: Column | str) -> Column:
    """Last three `_` tokens of a stem without `_Pro`, followed by the hint if there is one."""
    base = F.regexp_replace(F.regexp_replace(col(name_stem), r"_C\d+$", ""), "_Pro$", "")
    last = F.array_join(F.slice(F.split(base, "_"), F.greatest(F.lit(1), F.size(F.split(base, "_")) - 2), F.lit(3)), "_")
    return F.when(F.coalesce(col(hint), F.lit("")) == "", last).otherwise(F.concat_ws(" ", last, col(hint)))
