"""Parts of SQL that several oracles share."""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def plain(p: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(trim({p}, {BLANKS}), chr(92), '/'), '/+', '/', 'g'), '^(\./)+', '')"


def joint_class(c: str) -> str:
    x = f"lower(trim({c}))"
    return (
        f"case when {x} in ('normal', 'good') then 'normal' when {x} in ('excess', 'exc_solder') then 'excess'"
        f" when {x} in ('insufficient', 'poor_solder') then 'insufficient' when {x} = 'spike' then 'spike' end"
    )


def split_name(c: str) -> str:
    x = f"lower(trim({c}))"
    return f"case when {x} in ('train', 'training') then 'train' when {x} in ('val', 'valid', 'validation') then 'val' when {x} in ('test', 'testing') then 'test' end"


BOARD = f"coalesce(board, nullif(split_part({plain('dataset_path')}, '/', 2), ''))"
NUMBER = r"""regexp_replace(coalesce(nullif(regexp_extract(component_hint, '(\d+)', 1), ''),
  nullif(regexp_extract(image_name, '_C(\d+)\.[^.]*$', 1), '')), '^0+(\d)', '\1')"""
CROP = f"{plain('dataset_path')} || '#' || trim(polygon_rank_x)"
RECORDS = f"""
rec as (select distinct record_id, image_name, {plain('dataset_path')} as dataset_path, {BOARD} as board, package, viewpoint, light_direction, raw_label,
    coalesce({joint_class('"class"')}, {joint_class('raw_label')}) as class, points, merged_from from polygons),
box as (select *, list_min(list_transform(points, lambda p: p[1])) as bx0, list_min(list_transform(points, lambda p: p[2])) as by0,
    list_max(list_transform(points, lambda p: p[1])) as bx1, list_max(list_transform(points, lambda p: p[2])) as by1 from rec)"""
PHOTOS = f"""
ph as (select distinct photo_id, image_name, {plain('dataset_path')} as path, {BOARD} as board, package, viewpoint, nullif(trim(group_id), '') as group_id,
    {NUMBER} as number, case when regexp_matches(regexp_replace(lower(trim(fingerprint)), '^0x', ''), '^[0-9a-f]{{64}}$') and not regexp_matches(regexp_replace(lower(trim(fingerprint)), '^0x', ''), '^0+$')
    then regexp_replace(lower(trim(fingerprint)), '^0x', '') end as print from photo_groups),
pn as (select *, board || '/' || package as cell, regexp_replace(path, '^.*/', '') as name, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') as folder,
    regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') as stem from ph)"""
CROPS = f"""
cr as (select {CROP} as crop_id, min({joint_class('class_name')}) as class, min({split_name('split')}) as split, min(group_id) as group_id, min({BOARD}) as board, min(package) as package
    from crops group by 1)"""
SCORES = """
sc as (select distinct run_id, crop_id, label, pred, score from predictions)"""
LOGITS = """
sc as (select distinct run_id, crop_id, label, logits from predictions)"""
