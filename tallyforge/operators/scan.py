"""Content scanning: unsafe paths, secrets by line, private addresses, terms, duplicates, digest masking, archives.

Findings carry the line they are on and how often the rule matches there. Content that cannot be looked into is a finding
itself, never skipped.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Networks that are private or local, as first address and prefix length.
PRIVATE = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("100.64.0.0", 10), ("169.254.0.0", 16)]
#: What a path must not have: components, suffixes, whole leaf names, beginnings of a leaf, pieces of a leaf.
BAD_PARTS = [".git", ".ssh", ".aws", ".codex", ".claude", "secrets", ".secrets", ".operator", ".security-reports"]
BAD_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".token", ".secret", ".pt", ".pth", ".safetensors"]
BAD_LEAVES = [".env", "agents.local.md", "claude.local.md", ".security-private-terms", "id_rsa", "id_ed25519"]
BAD_BEGINNINGS, BAD_PIECES = [".env.", "credentials"], ["cookies", "storage-state"]
#: Limits of depth, bytes of one payload and bytes of all.
DEPTH, ITEM, TOTAL = 6, 64 << 20, 512 << 20

#: A character of a word, as a class without its brackets.
W = r"\p{L}\p{N}_"
#: What a line must not hold. None of these can span lines. Findings must be those of the rules as they were
#: published, so the expressions are stated as they are; W is what a word character means to this engine.
LINE_RULES = {
    "personal_path": r"""/(?:Users|home)/[^\s/"'<>]+|[A-Za-z]:\\Users\\[^\s\\]+""",
    "private_dns": rf"(?i)(?<![{W}])[{W}][{W}.-]*\.(?:ts\.net|internal|local)(?![{W}.-])",
    "url_credential": r"(?i)https?://[^\s/@:]+:[^\s/@]+@",
    "hidden_control": r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{E0000}-\x{E007F}]",
}
#: Of what a text in lower case must hold something, besides a hidden control, for any of these rules to match in it.
NEEDED = ["/users/", "/home/", ":\\users\\", ".ts.net", ".internal", ".local", "://"]
#: Fixed values, for the same reason: addresses.
QUAD = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
IPV4 = rf"(?<![{W}.])({QUAD})(?![{W}.])(?=(/[0-9]+)?)"
IPV6 = rf"(?<![{W}:])(?:f[cd][0-9a-f]{{2}}|fe[89ab][0-9a-f]):[0-9a-f:]+"
#: The one field whose digest is masked, and what stands for it.
DIGEST, MASK = rf'(?<![{W}])prompt_tokens_sha256": "[a-f0-9]{{64}}"', 'prompt_tokens_sha256": "SHA256_DIGEST"'


def unsafe_path(path: Column) -> Column:
    """The first rule that a path breaks, else null. Leaf names and suffixes count whatever their case."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    leaf = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")))
    suffix = F.regexp_extract(leaf, r"^\.*[^.].*(\.[^.]+)$", 1)
    return (
        F.when(path.startswith("/") | path.contains("\\"), "absolute_or_backslash").when(F.array_contains(parts, ".."), "parent")
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, BAD_PARTS))), "component").when(suffix.isin(BAD_SUFFIXES), "suffix")
        .when(leaf.isin(BAD_LEAVES) | _any(leaf.startswith, BAD_BEGINNINGS) | _any(leaf.contains, BAD_PIECES), "name")
    )


def _any(test, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(v)
    return out


def text_lines(payloads: DataFrame) -> DataFrame:
    """(name, line, t): the lines of each text, from 1."""
    return payloads.select("name", F.posexplode(F.split("text", "\n", -1)).alias("pos", "t")).select("name", (F.col("pos") + 1).alias("line"), "t")


def line_findings(payloads: DataFrame, rules: dict[str, str] = LINE_RULES) -> DataFrame:
    """(name, rule, line, n): how often a rule matches on a line."""
    if rules is LINE_RULES:  # most texts hold nothing that any rule could match: they are not split, let alone searched line by line
        held = F.get(F.transform(F.array(F.lower("text")), lambda low: _any(low.contains, NEEDED)), 0)
        payloads = payloads.where(held | F.col("text").rlike(rules["hidden_control"]))
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count("t", F.lit(p)).cast("long").alias("n")) for n, p in rules.items()])
    return text_lines(payloads).select("name", "line", F.inline(F.filter(counts, lambda x: x["n"] > 0))).select("name", "rule", "line", "n")


def private_ipv4(payloads: DataFrame) -> DataFrame:
    """(name, line, address, n) of private addresses; a network's own notation with its prefix length is no finding.

    An address stands alone: no letter, digit, underscore or dot touches it. Octets are decimal, without leading zeros.
    """
    each = lambda g: F.regexp_extract_all("t", F.lit(IPV4), F.lit(g))
    likely = text_lines(payloads.where(F.col("text").rlike(QUAD))).where(F.col("t").rlike(QUAD))
    found = likely.select("name", "line", F.inline(F.arrays_zip(each(1).alias("address"), each(2).alias("prefix"))))
    octets = F.split("address", "\\.")
    part = lambda i: F.element_at(octets, i).cast("long")
    number = part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)
    valid = F.forall(octets, lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    inside, notation = F.lit(False), F.lit(False)
    for network, bits in PRIVATE:
        a, b, c, d = map(int, network.split("."))
        low = a * 16777216 + b * 65536 + c * 256 + d
        inside = inside | number.between(low, low + 2 ** (32 - bits) - 1)
        notation = notation | ((F.col("address") == network) & F.col("prefix").startswith(f"/{bits}"))
    return found.where(valid & inside & ~notation).groupBy("name", "line", "address").agg(F.count("*").alias("n"))


def private_ipv6(payloads: DataFrame) -> DataFrame:
    """(name, line, address) of unique local and link-local addresses, in lower case."""
    likely = text_lines(payloads.where(F.col("text").rlike("(?i)f[cde][0-9a-f]{2}:")))
    return likely.select("name", "line", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(IPV6), F.lit(0))).alias("address"))


def term_search(payloads: DataFrame, terms: list[str]) -> DataFrame:
    """(name, term, line, n): how often a literal term stands on a line, whatever its case; blank terms are ignored."""
    terms = [t for t in terms if t.strip()]
    if not terms:
        return payloads.sparkSession.createDataFrame([], "name string, term string, line int, n long")
    low = F.col("t")  # texts are lowered once, before they are split
    times = lambda t: F.floor((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("long")
    counts = F.array(*[F.struct(F.lit(t).alias("term"), times(t).alias("n")) for t in terms])
    lines = text_lines(payloads.select("name", F.lower("text").alias("text"))).where(_any(F.col("t").contains, [t.lower() for t in terms]))
    return lines.select("name", "line", F.inline(F.filter(counts, lambda x: x["n"] > 0))).select("name", "term", "line", "n")


def findings(payloads: DataFrame, terms: list[str], order: str) -> DataFrame:
    """(rule, name, line, n) of all rules. Names are judged of every payload, contents once: where they were seen first."""
    named = payloads.select(unsafe_path(F.col("name")).alias("rule"), "name").where("rule is not null").select(F.lit("unsafe_name").alias("rule"), "name", F.lit(None).cast("int").alias("line"), F.lit(1).cast("long").alias("n"))
    sources = first_seen(payloads, order).select(F.col("name").alias("tf_first"))
    once = payloads.join(sources, payloads["name"] == sources["tf_first"], "left_semi").select("name", "text")
    parts = [
        line_findings(once),
        private_ipv4(once).select("name", F.lit("private_address").alias("rule"), "line", "n"),
        private_ipv6(once).groupBy("name", "line").agg(F.count("*").alias("n")).withColumn("rule", F.lit("private_ipv6")),
        term_search(once, terms).groupBy("name", "line").agg(F.sum("n").alias("n")).withColumn("rule", F.lit("private_term")),
    ]
    out = named
    for p in parts:
        out = out.unionByName(p.select("rule", "name", F.col("line").cast("int").alias("line"), "n"))
    return out


def first_seen(payloads: DataFrame, order: str) -> DataFrame:
    """(sha256, name, copies): the first payload of equal content."""
    return payloads.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min_by("name", order).alias("name"), F.count("*").alias("copies"))


def mask_digests(text: Column) -> tuple[Column, Column]:
    """(text with the digest field masked, how many)."""
    return F.regexp_replace(text, DIGEST, MASK), F.regexp_count(text, F.lit(DIGEST))


def merge_scanner(outside: DataFrame, sources: DataFrame, own: DataFrame) -> DataFrame:
    """(rule, name, n) of an outside scanner's findings (sha256, rule), by the name of their source, and of one's own."""
    placed = outside.join(sources.select("sha256", "name"), "sha256", "left").select("rule", F.coalesce("name", F.lit("scanner-input")).alias("name"), F.lit(1).cast("long").alias("n"))
    return placed.unionByName(own.select("rule", "name", "n")).groupBy("rule", "name").agg(F.sum("n").alias("n"))


def scan_summary(payloads: DataFrame, found: DataFrame) -> DataFrame:
    """One row: unique payloads, their bytes, digest fields masked, findings, and whether the scan is passed."""
    once = payloads.groupBy(F.sha2("text", 256).alias("h")).agg(F.max(F.octet_length("text")).alias("bytes"), F.max(F.when(F.col("text").contains("prompt_tokens_sha256"), mask_digests(F.col("text"))[1]).otherwise(0)).alias("masked"))
    a = once.agg(F.count("*").alias("unique_payloads"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("inspected_bytes"), F.coalesce(F.sum("masked"), F.lit(0)).cast("long").alias("masked_digests"))
    b = found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("findings"))
    return a.join(F.broadcast(b)).withColumn("passed", F.col("findings") == 0)  # single rows


def allowed_link(name: str, target: bytes, target_is_file: bool, target_content: bytes) -> bool:
    """The only symbolic link that is no finding: AGENTS.md to an empty regular file beside it. Fixed values."""
    return name == "AGENTS.md" and target == b"CLAUDE.md" and target_is_file and target_content == b""


#: Fixed value: content inside a text.
_DATA = re.compile(rb"data:[A-Za-z0-9_.+/-]+;base64,([A-Za-z0-9+/]+={0,2})")


def _unsafe(name: str) -> bool:
    """Whether a member of an archive breaks a rule of ``unsafe_path``."""
    parts = [x for x in name.split("/") if x not in ("", ".")]
    leaf = parts[-1].lower() if parts else ""
    suffix = re.match(r"\.*[^.].*(\.[^.]+)$", leaf, re.S)
    return (
        name.startswith("/") or "\\" in name or ".." in parts or not set(parts).isdisjoint(BAD_PARTS) or bool(suffix and suffix[1] in BAD_SUFFIXES)
        or leaf in BAD_LEAVES or leaf.startswith(tuple(BAD_BEGINNINGS)) or any(x in leaf for x in BAD_PIECES)
    )


Found = Iterator[tuple[str, bytes | None, str | None]]


def expand(name: str, content: bytes, depth: int = 0, room: list[int] | None = None) -> Found:
    """(name, content, problem) of a payload and of everything packed inside it, within the bounds of depth and size.

    What an archive says besides its members (comments, extended headers) is a payload too; members that cannot be looked
    into (encrypted, too large), links, unsafe names and owners by name are problems.
    """
    room = room if room is not None else [TOTAL]
    room[0] -= len(content)
    if depth > DEPTH or len(content) > ITEM or room[0] < 0:
        yield name, None, "too_large_or_deep"
        return
    yield name, content, None
    below = lambda n, c: expand(f"{name}!{n}", c, depth + 1, room)
    try:
        if content[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
                inner = f.read(ITEM + 1)
            yield from below("gz", inner)
        elif zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from _zip_members(name, z, below)
        elif content[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as t:
                yield from _tar_members(name, t, below)
        else:
            for k, m in enumerate(_DATA.finditer(content)):
                try:
                    inner = base64.b64decode(m[1], validate=True)
                except ValueError:
                    yield f"{name}!data{k}", None, "unreadable"
                    continue
                yield from below(f"data{k}", inner)
    except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, ValueError, RuntimeError):
        yield name, None, "unreadable"


def _zip_members(name: str, z: zipfile.ZipFile, below) -> Found:
    if z.comment:
        yield from below("comment", z.comment)
    for m in z.infolist():
        if _unsafe(m.filename):
            yield f"{name}!{m.filename}", None, "unsafe_member"
        elif (m.external_attr >> 16) & 0o170000 == 0o120000:
            yield f"{name}!{m.filename}", None, "link"
        elif not m.is_dir():
            if m.comment:
                yield from below(f"{m.filename}!comment", m.comment)
            if m.flag_bits & 1:
                yield f"{name}!{m.filename}", None, "encrypted"
            elif m.file_size > ITEM:
                yield f"{name}!{m.filename}", None, "too_large_or_deep"
            else:
                with z.open(m) as f:
                    yield from below(m.filename, f.read(ITEM + 1))


def _tar_members(name: str, t: tarfile.TarFile, below) -> Found:
    for m in t:
        if m.uname not in ("", "root") or m.gname not in ("", "root"):
            yield f"{name}!{m.name}", None, "owner_identity"
        if m.pax_headers:
            yield from below(f"{m.name}!pax", json.dumps(m.pax_headers).encode())
        if m.issym() or m.islnk():
            yield f"{name}!{m.name}", None, "link"
        elif _unsafe(m.name) or not (m.isfile() or m.isdir()):
            yield f"{name}!{m.name}", None, "unsafe_member"
        elif m.isfile():
            yield from below(m.name, t.extractfile(m).read(ITEM + 1))


class Members:
    """Rows (name, text, problem) of a file and all it packs, one at a time: no list of an archive is made."""

    def eval(self, path: str, content: bytes):
        for name, inner, problem in expand(path or "", bytes(content or b"")):
            text = None
            if inner is not None and problem is None and not (inner[:2] == b"\x1f\x8b" or zipfile.is_zipfile(io.BytesIO(inner)) or inner[257:262] == b"ustar"):
                try:
                    text = inner.decode("utf-8")
                    problem = "nul" if "\x00" in text else None
                except UnicodeDecodeError:
                    problem = "undecodable"
            yield name, text, problem


def expand_archives(files: DataFrame) -> DataFrame:
    """(name, text, problem) of (path, content) files and all they pack; undecodable content is a problem, not skipped.

    A lateral join with a table function: members leave a task as they are read, within the bounds of depth and bytes. A
    packed payload itself has neither text nor problem. Null content is an empty file, a null path an empty name.
    """
    members = F.udtf(Members, returnType="name string, text string, problem string")
    return files.select("path", "content").lateralJoin(members(F.col("path").outer(), F.col("content").outer())).select("name", "text", "problem")


def archive_findings(files: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(name, rule, line, n): what the rules find in every member of the files, and the problems of members, without a line."""
    members = expand_archives(files)
    texts = members.where("text is not null").select("name", "text")
    found = line_findings(texts, LINE_RULES if rules is None else rules).select("name", "rule", F.col("line").cast("int").alias("line"), "n")
    return found.unionByName(members.where("problem is not null").select("name", F.col("problem").alias("rule"), F.lit(None).cast("int").alias("line"), F.lit(1).cast("long").alias("n")))
