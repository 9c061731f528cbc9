"""End-to-end container conversions (inventory 2.10, R1): whole files in, named
files out.  Media data passes through unchanged; only containers change.

A file's length chain cannot be split, so a file is the unit of work:
``converted`` runs one of the functions below over a table of files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from tideline.functions import amf, audio, nal
from tideline.operators.scan import batches, taken
from tideline.sources import flv, hls, mp4, ts


def demuxed(data: bytes) -> dict:
    """Tracks of a tag container: configurations and samples (data, dts, cts,
    key) in ms."""
    out = {"avc": None, "aac": None, "video": [], "audio": [], "metadata": {}}
    for kind, t, body in flv.tags_of(data):
        if kind == flv.SCRIPT:
            found = amf.script(body)
            if found["name"] == "onMetaData" and isinstance(found["value"], dict):
                out["metadata"] = found["value"]
        elif kind == flv.VIDEO and len(body) >= 5 and body[0] & 15 == 7:
            if body[1] == 0:
                out["avc"] = body[5:]
            elif body[1] == 1 and len(body) > 5:
                out["video"].append((body[5:], t, int.from_bytes(body[2:5], "big", signed=True), body[0] >> 4 == 1))
        elif kind == flv.AUDIO and len(body) > 2 and body[0] >> 4 == 10:
            if body[1] == 0:
                out["aac"] = body[2:]
            else:
                out["audio"].append((body[2:], t, 0, True))
    return out


def rising(samples: list[tuple]) -> list[tuple]:
    """Samples in order of time, each later than the one before."""
    out = []
    for data, t, cts, key in sorted(samples, key=lambda s: s[1]):
        t = max(t, out[-1][1] + 1) if out else t
        out.append((data, t, cts, key))
    return out


def timed(samples: list[tuple], fallback: int = 40) -> list[tuple]:
    """(data, duration, cts, key): the last sample lasts as long as the one before."""
    gaps = [b[1] - a[1] for a, b in zip(samples, samples[1:], strict=False)]
    gaps.append(gaps[-1] if gaps else fallback)
    return [(d, g, c, k) for (d, _, c, k), g in zip(samples, gaps, strict=True)]


def descriptor(tag: int, body: bytes) -> bytes:
    return bytes([tag, 0x80 | len(body) >> 21 & 127, 0x80 | len(body) >> 14 & 127, 0x80 | len(body) >> 7 & 127, len(body) & 127]) + body


@lru_cache(maxsize=256)
def video_entry(avc: bytes) -> tuple[bytes, int, int]:
    config = nal.configuration(avc)
    size = nal.sps(config["sps"][0]) if config["sps"] else {"width": 0, "height": 0}
    head = b"\0" * 6 + b"\0\1" + b"\0" * 16 + size["width"].to_bytes(2, "big") + size["height"].to_bytes(2, "big") + b"\0\x48\0\0\0\x48\0\0" + b"\0" * 4 + b"\0\1" + b"\0" * 32 + b"\0\x18\xff\xff"
    return mp4.box("avc1", head, mp4.box("avcC", avc)), size["width"], size["height"]


@lru_cache(maxsize=256)
def audio_entry(aac: bytes) -> tuple[bytes, int]:
    config = audio.audio_config(aac)
    es = descriptor(3, b"\0\1\0" + descriptor(4, b"\x40\x15" + b"\0" * 11 + descriptor(5, aac)) + descriptor(6, b"\2"))
    head = b"\0" * 6 + b"\0\1" + b"\0" * 8 + config["channels"].to_bytes(2, "big") + b"\0\x10\0\0\0\0" + min(config["rate"], 65535).to_bytes(2, "big") + b"\0\0"
    return mp4.box("mp4a", head, mp4.full("esds", 0, 0, es)), config["rate"]


def specific_config(esds: bytes) -> bytes | None:
    """The AudioSpecificConfig inside an esds box's body."""
    at = 4

    def size(at: int) -> tuple[int, int]:
        n = 0
        for _ in range(4):
            b = esds[at]
            at, n = at + 1, n << 7 | b & 127
            if b < 128:
                break
        return n, at

    while at < len(esds):
        tag = esds[at]
        n, at = size(at + 1)
        if tag == 5:
            return esds[at : at + n]
        at += 3 if tag == 3 else 13 if tag == 4 else n
    return None


def muxed_mp4(tracks: dict) -> bytes:
    found = []
    if tracks["avc"] and tracks["video"]:
        entry, width, height = video_entry(tracks["avc"])
        found.append({"track_id": 1, "handler": "vide", "timescale": 1000, "entry": entry, "samples": timed(rising(tracks["video"])), "width": width, "height": height})
    if tracks["aac"] and tracks["audio"]:
        entry, _ = audio_entry(tracks["aac"])
        found.append({"track_id": 2, "handler": "soun", "timescale": 1000, "entry": entry, "samples": timed(rising(tracks["audio"]), 23)})
    if not found:
        raise ValueError("no track to write")
    return mp4.file_bytes(found)


def muxed_flv(tracks: dict) -> bytes:
    """Tags by time, video before audio where they tie (J5), from time 0."""
    has_v, has_a = bool(tracks["avc"]), bool(tracks["aac"])
    rows = [(s[1], 0, i, s) for i, s in enumerate(tracks["video"])] + [(s[1], 1, i, s) for i, s in enumerate(tracks["audio"])]
    base = min((r[0] for r in rows), default=0)
    out = bytearray(flv.file_header(has_a, has_v) + flv.tag_bytes(flv.SCRIPT, 0, amf.metadata(tracks.get("metadata") or {"duration": (max((r[0] for r in rows), default=0) - base) / 1000})))
    if has_v:
        out += flv.tag_bytes(flv.VIDEO, 0, b"\x17\0\0\0\0" + tracks["avc"])
    if has_a:
        out += flv.tag_bytes(flv.AUDIO, 0, b"\xaf\0" + tracks["aac"])
    for t, kind, _, (data, _, cts, key) in sorted(rows, key=lambda r: r[:3]):
        if kind == 0:
            out += flv.tag_bytes(flv.VIDEO, t - base, bytes([0x17 if key else 0x27, 1]) + (cts & 0xFFFFFF).to_bytes(3, "big") + data)
        else:
            out += flv.tag_bytes(flv.AUDIO, t - base, b"\xaf\1" + data)
    return bytes(out)


def demuxed_mp4(data: bytes) -> dict:
    """Tracks of an MP4 file, as ``demuxed`` gives them."""
    out = {"avc": None, "aac": None, "video": [], "audio": [], "metadata": {}}
    for t in mp4.tracks(data):
        name = {"avc1": "video", "mp4a": "audio"}.get(t["config"]["codec"])
        if name is None:
            continue
        config = t["config"]["data"]
        out["avc" if name == "video" else "aac"] = config if name == "video" else specific_config(config or b"")
        spc = {e["first_chunk"]: e["spc"] for e in t["stsc"]}
        deltas = [d["delta"] for d in t["stts"] for _ in range(d["count"])]
        shifts = [c["offset"] for c in t["ctts"] for _ in range(c["count"])] or [0] * len(deltas)
        keys = None if t["stss"] is None else set(t["stss"])
        ms = lambda x, scale=t["timescale"]: (2 * x * 1000 + scale) // (2 * scale)
        n, ticks, per = 0, 0, 0
        for chunk, at in enumerate(t["chunk_offsets"], 1):
            per = spc.get(chunk, per)
            for _ in range(per):
                if n >= len(t["sample_sizes"]):
                    break
                size = t["sample_sizes"][n]
                out[name].append((data[at : at + size], ms(ticks), ms(shifts[n]), keys is None or n + 1 in keys))
                ticks, at, n = ticks + deltas[n], at + size, n + 1
    return out


def segments_of(tracks: dict, target_ms: int) -> list[dict]:
    """Media of each segment, cut at keyframes (W10): rows (kind, sample)."""
    rows = sorted([(s[1], 0, i, s) for i, s in enumerate(rising(tracks["video"]))] + [(s[1], 1, i, s) for i, s in enumerate(rising(tracks["audio"]))], key=lambda r: r[:3])
    out: list[dict] = []
    for t, kind, _, s in rows:
        if not out or (t - out[-1]["start"] >= target_ms and (s[3] if kind == 0 else not tracks["video"])):
            out.append({"start": t, "end": t, "rows": []})
        out[-1]["end"] = max(out[-1]["end"], t)
        out[-1]["rows"].append((kind, s))
    for a, b in zip(out, out[1:], strict=False):
        a["end"] = b["start"]
    return out


def listing(durations: list[float], names: list[str], init: str | None = None, least: int = 0) -> bytes:
    top = max([least, *[int(-(-d // 1)) for d in durations]])
    lines = ["#EXTM3U", f"#EXT-X-VERSION:{7 if init else 3}", f"#EXT-X-TARGETDURATION:{top}", "#EXT-X-MEDIA-SEQUENCE:1", "#EXT-X-PLAYLIST-TYPE:VOD"] + ([f'#EXT-X-MAP:URI="{init}"'] if init else [])
    for d, n in zip(durations, names, strict=True):
        lines += [f"#EXTINF:{d:.3f},", n]
    return ("\n".join([*lines, "#EXT-X-ENDLIST"]) + "\n").encode()


def to_hls(tracks: dict, target_ms: int = 3000) -> dict[str, bytes]:
    config = nal.configuration(tracks["avc"]) if tracks["avc"] else None
    sound = audio.audio_config(tracks["aac"]) if tracks["aac"] else None
    w = ts.Writer(config is not None, 0x0F if sound else None)
    files, durations = {}, []
    for n, seg in enumerate(segments_of(tracks, target_ms), 1):
        data = bytearray(w.tables())
        for kind, (body, t, cts, key) in seg["rows"]:
            if kind == 0 and config:
                units = nal.from_lengths(body, config["length_size"])
                units = [b"\x09\xf0"] + (config["sps"] + config["pps"] if key else []) + units
                data += w.media(w.VIDEO, nal.to_annexb(units), 90 * (t + cts), 90 * t, pcr=90 * t)
            elif kind == 1 and sound:
                data += w.media(w.AUDIO, audio.adts_frame(body, sound["rate"], sound["channels"], sound["object_type"]), 90 * t)
        files[f"segment_{n}.ts"] = bytes(data)
        durations.append(max(0, seg["end"] - seg["start"]) / 1000)
    return files | {"index.m3u8": listing(durations, list(files), least=target_ms // 1000)}


def from_ts(data: bytes) -> dict:
    """Tracks of transport stream bytes (all segments, one after another)."""
    a = ts.Assembler()
    found = [x for p in ts.packets(data) for x in a.push(p["pid"], p["cc"], p["pusi"], p["payload"])] + a.finish()
    out = {"avc": None, "aac": None, "video": [], "audio": [], "metadata": {}}
    anchor = None
    sps = pps = None
    for x in found:
        if x["pts"] is None:
            continue
        t = x["dts"]
        if anchor is not None:  # nearest turn of the 33-bit clock (W19)
            t += round((anchor - t) / (1 << 33)) * (1 << 33)
        anchor = t if anchor is None else max(anchor, t)
        turn = t - x["dts"]
        if x["stream_kind"] == 0x1B:
            units = nal.from_annexb(x["data"])
            sps = next((u for u in units if nal.unit_type(u) == 7), sps)
            pps = next((u for u in units if nal.unit_type(u) == 8), pps)
            if sps and pps and out["avc"] is None:
                out["avc"] = nal.configuration_record([sps], [pps])
            media = [u for u in units if nal.unit_type(u) not in (7, 8, 9)]
            if media:
                out["video"].append((nal.to_lengths(media), (t + 45) // 90, (x["pts"] + turn - t + 45) // 90, nal.has_idr(media)))
        elif x["stream_kind"] == 0x0F:
            ticks = t
            for f in audio.adts_frames(x["data"]):
                out["aac"] = out["aac"] or audio.audio_config_bytes(f["object_type"], f["rate"], f["channels"])
                out["audio"].append((f["payload"], (ticks + 45) // 90, 0, True))
                ticks += 1024 * 90000 // f["rate"]
    return out


@lru_cache(maxsize=256)
def init_segment(avc: bytes | None, aac: bytes | None) -> bytes:
    """The init segment of fragments: it holds the configurations only."""
    entries = []
    if avc:
        entry, width, height = video_entry(avc)
        entries.append((1, "vide", entry, width, height))
    if aac:
        entries.append((2, "soun", audio_entry(aac)[0], 0, 0))
    traks = [mp4.track(i, h, 1000, 0, mp4.stbl([], [], [], None, [], [], e), w, hh) for i, h, e, w, hh in entries]
    mvhd = mp4.full("mvhd", 0, 0, b"\0" * 8 + (1000).to_bytes(4, "big") + b"\0" * 4 + b"\0\1\0\0\1\0" + b"\0" * 10, mp4.MATRIX, b"\0" * 24, b"\0\0\0\3")
    trex = [mp4.full("trex", 0, 0, i.to_bytes(4, "big") + b"\0\0\0\1" + b"\0" * 12) for i, *_ in entries]
    return mp4.box("ftyp", b"iso5\0\0\2\0iso5iso6mp41") + mp4.box("moov", mvhd, *traks, mp4.box("mvex", *trex))


def to_fmp4(tracks: dict, target_ms: int = 4000) -> dict[str, bytes]:
    files = {"init.mp4": init_segment(tracks["avc"], tracks["aac"])}
    names, durations, sequence = [], [], 1
    for n, seg in enumerate(segments_of(tracks, target_ms), 1):
        data = b""
        for kind in (0, 1):
            own = [s for k, s in seg["rows"] if k == kind]
            if own:
                data += mp4.fragment(sequence, kind + 1, own[0][1], timed(own))
                sequence += 1
        names.append(f"segment_{n}.m4s")
        files[names[-1]] = data
        durations.append(max(0, seg["end"] - seg["start"]) / 1000)
    return files | {"index.m3u8": listing(durations, names, "init.mp4")}


@lru_cache(maxsize=256)
def init_tracks(init: bytes) -> tuple[bytes | None, bytes | None, dict]:
    """Configurations of an init segment, and kind and timescale of its tracks."""
    avc, aac, kinds = None, None, {}
    for t in mp4.tracks(init):
        name = {"avc1": "video", "mp4a": "audio"}.get(t["config"]["codec"])
        kinds[t["track_id"]] = (name, t["timescale"])
        if name == "video":
            avc = t["config"]["data"]
        elif name == "audio":
            aac = specific_config(t["config"]["data"] or b"")
    return avc, aac, kinds


def from_fmp4(init: bytes, media: bytes) -> dict:
    avc, aac, kinds = init_tracks(init)
    out = {"avc": avc, "aac": aac, "video": [], "audio": [], "metadata": {}}
    for s in mp4.fragment_samples(media):
        name, scale = kinds.get(s["track_id"], (None, 1))
        if name:  # each track in its own timescale
            out[name].append((media[s["offset"] : s["offset"] + s["size"]], (2 * s["dts"] * 1000 + scale) // (2 * scale), (2 * s["cts"] * 1000 + scale) // (2 * scale), s["is_key"]))
    return out


def from_playlist(text: bytes, files: dict[str, bytes]) -> dict:
    """Tracks of a playlist's segments, of either kind."""
    found = hls.playlist(text.decode())["segments"]
    media = b"".join(files[s["uri"]] for s in found)
    return from_fmp4(files[found[0]["init"]], media) if found and found[0]["init"] else from_ts(media)


def to_split_fmp4(tracks: dict, target_ms: int = 4000) -> dict[str, bytes]:
    """Each track with its own init segment and segments (W11), and a playlist
    that names both."""
    found = {"video": tracks | {"aac": None, "audio": []}, "audio": tracks | {"avc": None, "video": []}}
    files = {f"{name}/{k}": v for name, own in found.items() if own[name] for k, v in to_fmp4(own, target_ms).items()}
    lines = ["#EXTM3U", "#EXT-X-VERSION:7"]
    if found["audio"]["audio"] and found["video"]["video"]:
        lines.append('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="audio",NAME="audio",URI="audio/index.m3u8"')
    lines += ["#EXT-X-STREAM-INF:BANDWIDTH=1000000", "video/index.m3u8" if found["video"]["video"] else "audio/index.m3u8"]
    return files | {"index.m3u8": ("\n".join(lines) + "\n").encode()}


def from_folder(files: dict[str, bytes]) -> dict:
    """Tracks of a folder of playlists and segments: of ``index.m3u8``, which may
    name one playlist for each track."""
    top = hls.playlist(files["index.m3u8"].decode())
    if not top["children"]:
        return from_playlist(files["index.m3u8"], files)
    out = {"avc": None, "aac": None, "video": [], "audio": [], "metadata": {}}
    for child in top["children"]:
        folder = child.rpartition("/")[0] + "/"
        one = from_playlist(files[child], {k.removeprefix(folder): v for k, v in files.items() if k.startswith(folder)})
        out = {k: out[k] or one[k] for k in out}
    return out


def from_adts(data: bytes) -> dict:
    """Tracks of an ADTS stream: frames of 1,024 samples from time 0."""
    out = {"avc": None, "aac": None, "video": [], "audio": [], "metadata": {}}
    for i, f in enumerate(audio.adts_frames(data)):
        out["aac"] = out["aac"] or audio.audio_config_bytes(f["object_type"], f["rate"], f["channels"])
        out["audio"].append((f["payload"], (2 * i * 1024 * 1000 + f["rate"]) // (2 * f["rate"]), 0, True))
    return out


def to_adts(tracks: dict) -> bytes:
    if not tracks["aac"]:
        raise ValueError("no AAC track")
    c = audio.audio_config(tracks["aac"])
    return b"".join(audio.adts_frame(s[0], c["rate"], c["channels"], c["object_type"]) for s in tracks["audio"])


def aac_of(data: bytes) -> dict:
    """Tracks of whatever holds AAC, by its first bytes."""
    readers = {"flv": demuxed, "mp4": demuxed_mp4, "adts": from_adts}
    kind = audio.sniffed(data)
    if kind not in readers:
        raise ValueError(f"no AAC in a container of kind {kind}")
    return readers[kind](data)


def pcm_of(data: bytes) -> bytes:
    """The samples of a 16-bit PCM WAVE file."""
    head = audio.wav_header(data)
    if head["format"] != 1 or head["bits"] != 16:
        raise ValueError("not 16-bit PCM")
    return data[head["data_offset"] : head["data_offset"] + head["data_size"]]


#: Conversions of single files, by name: bytes in, named bytes out.
CONVERSIONS: dict[str, Callable[[bytes], dict[str, bytes]]] = {
    "flv_to_mp4": lambda d: {"output.mp4": muxed_mp4(demuxed(d))},
    "flv_to_hls": lambda d: to_hls(demuxed(d)),
    "flv_to_fmp4": lambda d: to_fmp4(demuxed(d)),
    "mp4_to_flv": lambda d: {"output.flv": muxed_flv(demuxed_mp4(d))},
    "mp4_to_hls": lambda d: to_hls(demuxed_mp4(d)),
    "mp4_to_fmp4": lambda d: to_fmp4(demuxed_mp4(d)),
    "ts_to_flv": lambda d: {"output.flv": muxed_flv(from_ts(d))},
    "ts_to_mp4": lambda d: {"output.mp4": muxed_mp4(from_ts(d))},
    "flv_to_split_fmp4": lambda d: to_split_fmp4(demuxed(d)),
    "mp4_to_split_fmp4": lambda d: to_split_fmp4(demuxed_mp4(d)),
    "aac_to_adts": lambda d: {"output.aac": to_adts(aac_of(d))},
    "aac_to_flv": lambda d: {"output.flv": muxed_flv(aac_of(d) | {"avc": None, "video": []})},
    "aac_to_mp4": lambda d: {"output.mp4": muxed_mp4(aac_of(d) | {"avc": None, "video": []})},
    "wav_to_pcm": lambda d: {"output.pcm": pcm_of(d)},
    "pcm_to_wav": lambda d: {"output.wav": audio.wav_bytes(d, 48000, 2)},
}

#: Conversions of folders with an ``index.m3u8``: named bytes in, named bytes out.
FOLDER_CONVERSIONS: dict[str, Callable[[dict[str, bytes]], dict[str, bytes]]] = {
    "hls_to_flv": lambda f: {"output.flv": muxed_flv(from_folder(f))},
    "hls_to_mp4": lambda f: {"output.mp4": muxed_mp4(from_folder(f))},
    "fmp4_to_flv": lambda f: {"output.flv": muxed_flv(from_folder(f))},
    "fmp4_to_mp4": lambda f: {"output.mp4": muxed_mp4(from_folder(f))},
    "fmp4_to_hls": lambda f: to_hls(from_folder(f)),
}


def converted(files: DataFrame, conversion: str) -> DataFrame:
    """(path, name, content) of a conversion over ``binaryFile`` rows."""
    import pyarrow as pa

    turn = CONVERSIONS[conversion]
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary())])

    def run(found):
        return batches(((path, *made) for path, content in taken(found) for made in turn(content).items()), schema)

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def converted_folders(files: DataFrame, conversion: str, together: bool = False) -> DataFrame:
    """(folder, name, content) of a conversion over rows (folder, name, content):
    a folder, like a file above, is the unit of work.  ``together``: a folder's
    rows follow one another already, as ``converted`` gives them, and need no
    shuffle."""
    import pyarrow as pa

    turn = FOLDER_CONVERSIONS[conversion]
    schema = pa.schema([("folder", pa.string()), ("name", pa.string()), ("content", pa.binary())])

    def made(found):
        folder, own = None, {}
        for at, name, content in taken(found):
            if own and at != folder:
                yield from ((folder, *x) for x in turn(own).items())
                own = {}
            folder = at
            own[name] = content
        if own:
            yield from ((folder, *x) for x in turn(own).items())

    rows = files.select("folder", "name", "content")
    rows = rows if together else rows.repartition("folder").sortWithinPartitions("folder")
    return rows.mapInArrow(lambda found: batches(made(found), schema), "folder string, name string, content binary")
