"""Playlists (inventory S11)."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def playlist(text: str) -> dict:
    """Segments (seq, uri, duration, init) and child playlists of a playlist."""
    lines = [x.strip() for x in text.replace("\r\n", "\n").split("\n")]
    if not lines or not lines[0].lstrip("﻿").startswith("#EXTM3U"):
        raise ValueError("not a playlist")
    segments, children, duration, init, variant = [], [], None, None, False
    sequence = 0
    for line in lines[1:]:
        tag = line.partition(":")[0] if line[:1] == "#" and ":" in line else ""
        if tag == "#EXTINF":
            duration = float(line[8:].split(",")[0] or 0)
        elif tag == "#EXT-X-MEDIA-SEQUENCE":
            sequence = int(line.split(":")[1])
        elif tag == "#EXT-X-MAP":
            init = (re.search(r'URI="([^"]*)"', line) or [None, None])[1]
        elif tag == "#EXT-X-MEDIA":
            found = re.search(r'URI="([^"]*)"', line)
            if found:
                children.append(found[1])
        elif line.startswith("#EXT-X-STREAM-INF"):
            variant = True
        elif line and not line.startswith("#"):
            if variant:
                children.append(line)
                variant = False
            else:
                segments.append({"seq": sequence + len(segments), "uri": line, "duration": duration, "init": init})
            duration = None
    return {"segments": segments, "children": children}


def collected(path: str, read) -> list[dict]:
    """Segments of a playlist and its children however deep, each path once, in order;
    ``read`` gives a path's text.  URIs resolve against their playlist."""
    seen: set[str] = set()
    out: list[dict] = []

    def resolve(base: str, uri: str) -> str:
        parts = urlsplit(uri)
        if parts.scheme or uri.startswith("/"):
            return uri
        return f"{base.rsplit('/', 1)[0]}/{unquote(parts.path)}" if "/" in base else unquote(parts.path)

    waiting = [path]
    while waiting:
        at = waiting.pop()
        if at in seen:
            continue
        seen.add(at)
        found = playlist(read(at))
        for s in found["segments"]:
            uri = resolve(at, s["uri"])
            if uri not in seen:
                seen.add(uri)
                out.append(s | {"uri": uri, "init": s["init"] and resolve(at, s["init"])})
        waiting += [resolve(at, c) for c in reversed(found["children"])]
    return out


def scanned(texts: DataFrame, name: str = "path", text: str = "value") -> DataFrame:
    """(name, seq, uri, duration) of whole playlist texts, by SQL functions."""
    entries = F.regexp_extract_all(F.col(text), F.lit(r"#EXTINF:([0-9.]+)[^\n]*\n(?:#[^\n]*\n)*([^#\n][^\n]*)"), F.lit(0))
    rows = texts.select(name, F.posexplode(entries).alias("seq", "e"))
    return rows.select(name, "seq", F.trim(F.regexp_extract("e", r"\n([^#\n][^\n]*)$", 1)).alias("uri"), F.regexp_extract("e", r"#EXTINF:([0-9.]+)", 1).cast("double").alias("duration"))
