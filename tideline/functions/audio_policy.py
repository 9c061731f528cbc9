"""What to do with an audio track (inventory P8-P11), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sound formats of the tag header, in the order of their numbers.
SOUND_FORMATS = {0: "pcm", 2: "mp3", 3: "pcm", 7: "pcm_alaw", 8: "pcm_mulaw", 10: "aac", 14: "mp3"}


def sound_format(first_byte: Column) -> Column:
    """Codec name of a tag's first audio byte; ``unknown`` if none is known."""
    code = F.shiftrightunsigned(first_byte, 4)
    out = F.lit("unknown")
    for k, name in SOUND_FORMATS.items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def decision(source: Column, target: Column) -> tuple[Column, Column]:
    """(output codec, mode): unknown sources become silent AAC (to MP3 they are
    an error); Opus and PCM are always transcoded; others pass through unless
    the target differs."""
    unknown = source.startswith("unknown")
    raw = source.isin("opus", "pcm")
    output = F.when(unknown, F.when(target == "mp3", F.lit(None)).otherwise(F.lit("aac"))).when(raw, F.coalesce(target, F.lit("aac"))).otherwise(F.coalesce(target, source))
    mode = (
        F.when(unknown, F.when(target == "mp3", F.lit("error")).otherwise(F.lit("silent")))
        .when(raw, F.lit("transcode"))
        .otherwise(F.when(target.isNotNull() & (target != source), F.lit("transcode")).otherwise(F.lit("passthrough")))
    )
    return output, mode


def no_upscale(width: Column, height: Column, fps: Column, to_width: int | None, to_height: int | None, to_fps: float | None) -> Column:
    """Error text of an output that would enlarge width, height or rate; null if it is fine."""
    checks = [(width, to_width, "width"), (height, to_height, "height"), (fps, to_fps, "fps")]
    out = F.lit(None).cast("string")
    for have, want, name in reversed(checks):
        if want:
            out = F.when(have < want, F.lit(f"output {name} exceeds the source")).otherwise(out)
    return out


#: Four-character codes of enhanced audio tags.
FOURCC = {b"mp4a": "aac", b".mp3": "mp3", b"Opus": "opus", b"fLaC": "unknown:flac", b"ac-3": "unknown:ac3", b"ec-3": "unknown:eac3"}


def classified(body: bytes) -> dict:
    """Codec, packet kind and payload of an audio tag body.  Sound format 9
    is an enhanced tag: its low bits are the packet type, a four-character code
    follows, and a multitrack packet (5) has a kind, its own type and a track
    number before the payload."""
    if not body:
        return {"codec": "unknown", "header": False, "payload": b"", "track": None}
    form = body[0] >> 4
    if form != 9:
        codec = SOUND_FORMATS.get(form, f"unknown:{form}")
        if codec == "aac":
            return {"codec": codec, "header": len(body) > 1 and body[1] == 0, "payload": body[2:], "track": None}
        return {"codec": codec, "header": False, "payload": body[1:], "track": None}
    kind, at, track = body[0] & 15, 1, None
    multi = kind == 5
    if multi:
        kind, at = body[1] & 15, 2
    codec = FOURCC.get(body[at : at + 4], "unknown:" + body[at : at + 4].decode("latin-1"))
    at += 4
    if multi:
        track, at = body[at], at + 1
    return {"codec": codec, "header": kind == 0, "payload": body[at:], "track": track}


def transcodable(source: str, target: str, rate: int, channels: int) -> str | None:
    """P10: why a transcode cannot be done; null if it can."""
    if channels not in (1, 2):
        return f"{channels} channels"
    if source not in ("aac", "mp3", "opus", "pcm"):
        return f"no decoder for {source}"
    if target == "mp3" and rate not in (32000, 44100, 48000):
        return f"mp3 at {rate} Hz"
    if target == "opus" and rate != 48000:
        return f"opus at {rate} Hz"
    return None if target in ("aac", "mp3", "opus", "pcm") else f"no encoder for {target}"
