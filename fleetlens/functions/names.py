"""Fact names and their readable forms.

Fixed values: the forms ``owner::lib`` of npm packages, ``Kind::namespace::name``
of Kubernetes specs and ``group:artifact`` of Maven coordinates are formats that
stored facts have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def npm_name_encode(lib: Column) -> Column:
    """Drop the first '@' and turn the first '/' into '::'."""
    no_at = F.regexp_replace(lib, "^([^@]*)@", "$1")
    return F.regexp_replace(no_at, "^([^/]*)/", "$1::")


def npm_name_decode(name: Column) -> Column:
    """owner::lib -> @owner/lib; lib -> lib; null when it is neither."""
    at = F.instr(name, "::")
    owner = F.when(at > 0, F.substr(name, F.lit(1), at - 1)).otherwise(name)
    full = F.when(at > 0, F.concat(F.lit("@"), owner, F.lit("/"), F.substr(name, at + 2))).otherwise(name)
    return F.when((owner != "") & ~F.contains(owner, F.lit(":")), full)


def k8s_name(kind: Column, namespace: Column, name: Column) -> Column:
    """Kind::[namespace::]name; an empty namespace is left out."""
    return F.concat_ws("::", kind, F.nullif(namespace, F.lit("")), name)


def k8s_display_name(name: Column) -> Column:
    return F.replace(name, F.lit("::"), F.lit("/"))


def maven_name(group: Column, artifact: Column) -> Column:
    return F.concat(group, F.lit(":"), artifact)
