"""Pieces of SQL that the comparison queries share."""

from lectern.tables import CHUNK_DEFAULTS


def instant(c: str) -> str:
    """An ISO 8601 text as a UTC timestamp."""
    t = f"trim({c})"
    zone = rf"regexp_extract({t}, '([+-]\d{{2}}:?\d{{2}})$', 1)"
    return rf"""(case when regexp_matches({t}, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}') then try_cast(replace(substr({t}, 1, 19), 'T', ' ') as timestamp)
      + coalesce(interval 1 microsecond * cast(rpad(nullif(regexp_extract({t}, '\.(\d{{1,6}})', 1), ''), 6, '0') as integer), interval 0 hour)
      - case when {zone} <> '' then (case when substr({zone}, 1, 1) = '-' then -1 else 1 end) * (interval 1 hour * cast(substr({zone}, 2, 2) as integer) + interval 1 minute * cast(right({zone}, 2) as integer)) else interval 0 hour end end)"""


def _default(c: str, v) -> str:
    return f"coalesce({c}, {v!r}) as {c}" if isinstance(v, str) else f"coalesce({c}, {v}) as {c}"


CHUNKS = f"""ch as (select id, vector, {', '.join(_default(c, v) for c, v in CHUNK_DEFAULTS.items())}
    from (select *, row_number() over (partition by id order by indexed_at desc nulls last) rn from chunks where id is not null) where rn = 1)"""
BOOKS = f"""bk as (select * exclude (rn) from (select *, {instant('modified_at')} as modified, row_number() over (partition by source_id order by {instant('modified_at')} desc nulls last) rn
    from catalogue where source_id is not null) where rn = 1)"""
#: The vector that searches start from: the first usable one by id.
QUERY = """qv as (select cast(vector as double[]) q from ch where len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 order by id limit 1)"""
COSINE = "list_dot_product(cast(vector as double[]), q) / (sqrt(list_dot_product(cast(vector as double[]), cast(vector as double[]))) * sqrt(list_dot_product(q, q)))"
#: A usable vector.
OK = "len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def bm25(terms: list[str], where: str = "true") -> str:
    """Common table expressions ``kw`` (id, score) for the terms."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) filter (where tf{i} > 0) df{i}" for i in range(len(terms)))
    parts = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * l / av))" for i in range(len(terms)))
    any_ = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""tk as (select *, {TOKENS} t from ch), tl as (select * exclude (t), len(t) l, {tf} from tk),
      st as (select count(*) n, avg(l) av, {df} from tl),
      kw as (select id, round({parts}, 6) score from tl, st where ({any_}) and ({where}))"""
