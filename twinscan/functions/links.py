"""Repository and object-store links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscan.functions.text import strip


def link_type(link: Column) -> Column:
    """s3, github, gitlab or null; first match wins."""
    low = F.lower(link)
    return (
        F.when(low.startswith("s3://") | low.contains(".s3.") | low.contains("amazonaws.com"), "s3")
        .when(low.contains("github.com"), "github")
        .when(low.contains("gitlab.com") | low.contains("/gitlab"), "gitlab")
    )


def repo_name(link: Column) -> Column:
    """Last path segment without `.git`; 'repo' when the link has no slash."""
    parts = F.split(F.regexp_replace(link, "/+$", ""), "/")
    return F.when(F.size(parts) >= 2, F.regexp_replace(F.element_at(parts, -1), "[.]git$", "")).otherwise(
        F.lit("repo")
    )


def parse_s3_url(link: Column) -> Column:
    """Struct(bucket, key); null when the scheme, the bucket or the key is missing."""
    bucket = F.regexp_extract(link, "^s3://([^/?#]*)", 1)
    key = F.regexp_replace(F.regexp_extract(link, "^s3://[^/?#]*(/[^?#]*)", 1), "^/+", "")
    return F.when(
        link.startswith("s3://") & (bucket != "") & (key != ""),
        F.struct(bucket.alias("bucket"), key.alias("key")),
    )


def _with_git(url: Column) -> Column:
    return F.when(url.endswith(".git"), url).otherwise(F.concat(url, F.lit(".git")))


def _slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def normalize_repo_url(link: Column, kind: str) -> Column:
    """Clone URL `https://host/path.git`; null for unsupported forms. `kind`: github or gitlab."""
    url = strip(link)
    if kind == "github":
        web = F.replace(F.replace(_with_git(url), F.lit("https://github.com/"), F.lit("")), F.lit(".git"), F.lit(""))
        ssh = F.regexp_replace(F.replace(url, F.lit("git@github.com:"), F.lit("")), "/+$", "")
        short = F.regexp_replace(url, "/+$", "")
        return (
            F.when(url.startswith("https://github.com/"), F.when(_slashes(web) == 1, _with_git(url)))
            .when(url.startswith("git@github.com:"), F.when(ssh.contains("/"), F.concat(F.lit("https://github.com/"), _with_git(ssh))))
            .when(
                url.contains("/") & ~url.startswith("http"),
                F.when(_slashes(short) == 1, F.concat(F.lit("https://github.com/"), short, F.lit(".git"))),
            )
        )
    web = F.replace(F.replace(_with_git(url), F.lit("https://gitlab.com/"), F.lit("")), F.lit(".git"), F.lit(""))
    ssh = F.regexp_replace(F.replace(url, F.lit("git@gitlab.com:"), F.lit("")), "/+$", "")
    halves = F.split(url, ":")
    host = F.replace(F.element_at(halves, 1), F.lit("git@"), F.lit(""))
    tail = F.regexp_replace(F.try_element_at(halves, F.lit(2)), "/+$", "")
    low = F.lower(url)
    return (
        F.when(url.startswith("https://gitlab.com/"), F.when(web.contains("/"), _with_git(url)))
        .when(
            url.startswith("git@gitlab.com:"),
            F.when(ssh.contains("/"), F.concat(F.lit("https://gitlab.com/"), ssh, F.lit(".git"))),
        )
        .when(url.startswith("https://") & low.contains("gitlab"), F.when(_slashes(_with_git(url)) >= 4, _with_git(url)))
        .when(
            url.startswith("git@") & low.contains("gitlab"),
            F.when(
                (F.size(halves) == 2) & tail.contains("/"),
                F.concat(F.lit("https://"), host, F.lit("/"), tail, F.lit(".git")),
            ),
        )
    )
