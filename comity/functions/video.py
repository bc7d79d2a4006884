"""Video ids out of links, as native expressions. Null means "no id"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from comity.functions.text import strip

ID = "[A-Za-z0-9_-]{11}"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _bare(c: Column) -> Column:
    return F.when(c.rlike(rf"^{ID}\z"), c)


def _netloc(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def _path(c: Column) -> Column:
    return F.regexp_extract(
        c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )


def _v_parameter(c: Column) -> Column:
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    raw = _first(query, r"(?:^|&)v=([^&]+)")
    return F.coalesce(F.try_url_decode(raw), raw)


def _short_link(c: Column) -> Column:
    first_part = F.element_at(F.split(F.trim(_path(c), F.lit("/")), "/"), 1)
    return _bare(first_part)


def video_id_strict(link: Column | str) -> Column:
    """A bare id, or the id in one of the four known link forms."""
    c = strip(F.col(link) if isinstance(link, str) else link)
    return F.coalesce(
        _bare(c),
        _first(c, rf"youtube\.com/watch\?v=({ID})"),
        _first(c, rf"youtu\.be/({ID})"),
        _first(c, rf"youtube\.com/embed/({ID})"),
        _first(c, rf"youtube\.com/shorts/({ID})"),
    )


def video_id_by_host(link: Column | str) -> Column:
    """A bare id, else by host: the ``v`` parameter is taken as it stands."""
    c = strip(F.col(link) if isinstance(link, str) else link)
    host = F.lower(F.regexp_extract(_netloc(c), r"([^@:]*)(?::[^@]*)?$", 1))
    path = _path(c)
    long_host = host.contains("youtube.com") | host.contains("youtube-nocookie.com")
    long_form = F.coalesce(
        _v_parameter(c), _first(path, rf"/shorts/({ID})"), _first(path, rf"/embed/({ID})")
    )
    return F.coalesce(
        _bare(c),
        F.when(long_host, long_form),
        F.when(host.contains("youtu.be"), _short_link(c)),
    )


def video_id_any_host(link: Column | str) -> Column:
    """No host check; the ``v`` parameter must look like an id. A bare id is no link."""
    c = strip(F.col(link) if isinstance(link, str) else link)
    return F.coalesce(
        _bare(_v_parameter(c)),
        F.when(_netloc(c).contains("youtu.be"), _short_link(c)),
        _first(c, rf"/shorts/({ID})"),
        _first(c, rf"/embed/({ID})"),
    )
