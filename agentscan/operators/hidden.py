"""Text that does not show: invisible characters, look-alikes, hidden runs and encoded payloads."""

from __future__ import annotations

import base64
import codecs
import string
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from agentscan.functions.held import holding
from agentscan.functions.rules import any_match, quoted, rows_of
from agentscan.operators.text import INJECTION, TEXT_RULES
from agentscan.sources.derived import SQL_ARTIFACTS, artifacts

#: Classes of invisible characters, and the surroundings in which two of them are usual.
ZERO_WIDTH = "[\\x{200B}\\x{2060}\\x{FEFF}]"
JOINERS = "[\\x{200C}\\x{200D}]"
USUAL_JOINERS = "[\\x{0600}-\\x{06FF}\\x{0900}-\\x{0D7F}\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}][\\x{200C}\\x{200D}]"
BIDI = "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]"
TAGS = "[\\x{E0020}-\\x{E007E}]"
ANY = "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{E0020}-\\x{E007E}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"
CYRILLIC = "[A-Za-z][\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0443}\\x{0445}\\x{0456}\\x{0458}\\x{0455}]"
#: Runs that may hide bits, and tag characters with the ASCII ones they stand for.
RUN, TAG_RUN = "[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}]{8,}", "[\\x{E0020}-\\x{E007E}]{4,}"
TAG_LETTERS, ASCII = "".join(chr(0xE0000 + i) for i in range(0x20, 0x7F)), "".join(chr(i) for i in range(0x20, 0x7F))
PAYLOADS = [*TEXT_RULES["TEXT-001"], *[r.pattern for r in INJECTION[:5]]]
PAYLOAD = "|".join(f"(?:{p})" for p in PAYLOADS)

#: Variation selectors, those behind emoji or digits, letters written from right to left, and look-alikes between Latin letters.
SELECTORS, USUAL_SELECTORS = "[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]", "[\\x{1F000}-\\x{1FAFF}\\x{2190}-\\x{2BFF}\\x{3030}\\x{303D}\\x{00A9}\\x{00AE}0-9#*][\\x{FE00}-\\x{FE0F}]"
RIGHT_TO_LEFT = "[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFC}]"
BETWEEN = CYRILLIC + "[A-Za-z]"
#: Characters and pairs of characters of which every match of ANY and of CYRILLIC holds one, in lower case.
SIGNS = tuple(chr(i) for a, b in ((0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0x202A, 0x202E), (0x2066, 0x2069), (0xE0020, 0xE007E), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)) for i in range(a, b + 1))
LOOK_ALIKE = tuple(a + chr(b) for a in string.ascii_lowercase for b in (0x430, 0x435, 0x43E, 0x440, 0x441, 0x443, 0x445, 0x456, 0x458, 0x455))

_COUNTS = {"selectors": (SELECTORS, 1), "usual_selectors": (USUAL_SELECTORS, 1), "rtl": (RIGHT_TO_LEFT, 1), "zero_width": (ZERO_WIDTH, 1), "joiners": (JOINERS, 1), "usual_joiners": (USUAL_JOINERS, 1), "bidi": (BIDI, 1), "tags": (TAGS, 1)}


def q_invisible(spark, sf_dir):
    """Invisible characters of each text by class, without joiners where scripts or emoji use them."""
    a = holding(artifacts(spark, sf_dir), "content", SIGNS).where(F.col("content").rlike(ANY))  # one pass tells the few texts that have any
    n = {k: F.regexp_count("content", F.lit(p)) for k, (p, _) in _COUNTS.items()}
    odd, strange = n["joiners"] - n["usual_joiners"], n["selectors"] - n["usual_selectors"]
    bidi = F.when(n["rtl"] * 10 > F.length("content"), 0).otherwise(n["bidi"])  # usual where a tenth of the text runs from right to left
    check = F.when(n["tags"] > 0, "UNICODE-STEGO-004").when(n["zero_width"] + odd + bidi + strange > 0, "UNICODE-STEGO-001")
    return a.select("id", n["zero_width"].alias("zero_width"), odd.alias("joiners"), bidi.alias("bidi"), strange.alias("selectors"), n["tags"].alias("tags"), check.alias("check_id")).where("check_id is not null")


def _n(p: str) -> str:
    return f"len(regexp_extract_all(content, {quoted(p)}))::INT"


SQL_INVISIBLE = f"""WITH {SQL_ARTIFACTS}, n AS (SELECT id, {_n(ZERO_WIDTH)} AS zero_width, {_n(JOINERS)} - {_n(USUAL_JOINERS)} AS joiners, CASE WHEN {_n(RIGHT_TO_LEFT)} * 10 > length(content) THEN 0 ELSE {_n(BIDI)} END AS bidi, {_n(SELECTORS)} - {_n(USUAL_SELECTORS)} AS selectors, {_n(TAGS)} AS tags FROM artifacts)
SELECT *, CASE WHEN tags > 0 THEN 'UNICODE-STEGO-004' ELSE 'UNICODE-STEGO-001' END AS check_id FROM n WHERE tags > 0 OR zero_width + joiners + bidi + selectors > 0"""


def q_homoglyphs(spark, sf_dir):
    """Cyrillic look-alikes right after a Latin letter: mixed words, and how many stand between Latin letters."""
    n = F.regexp_count("content", F.lit(CYRILLIC))
    a = holding(artifacts(spark, sf_dir), "content", LOOK_ALIKE)
    return a.select("id", n.alias("n_mixed"), F.regexp_count("content", F.lit(BETWEEN)).alias("n_between"), F.regexp_extract("content", f"(\\S*{CYRILLIC}\\S*)", 1).alias("sample")).where("n_mixed > 0")


SQL_HOMOGLYPHS = f"WITH {SQL_ARTIFACTS} SELECT id, {_n(CYRILLIC)} AS n_mixed, {_n(BETWEEN)} AS n_between, regexp_extract(content, {quoted(f'(\\S*{CYRILLIC}\\S*)')}, 1) AS sample FROM artifacts WHERE regexp_matches(content, {quoted(CYRILLIC)})"


def q_hidden_runs(spark, sf_dir):
    """Runs of zero-width symbols over exactly two of their alphabet as bits, in both orders, and tag characters as text."""
    a = holding(artifacts(spark, sf_dir), "content", SIGNS).where(F.col("content").rlike(f"{RUN}|{TAG_RUN}"))
    runs = a.select("id", F.posexplode(F.regexp_extract_all("content", F.lit(RUN), F.lit(0))).alias("run_no", "run"))
    symbols = F.array_sort(F.array_distinct(F.split("run", "")))
    runs = runs.withColumn("s", symbols).where(F.size("s") == 2)
    bits = F.array_join(F.transform(F.split("run", ""), lambda c: F.when(c == F.col("s")[0], "0").otherwise("1")), "")
    chars = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(b) / 8).cast("int") - 1), lambda i: F.char(F.conv(F.substring(b, i * 8 + 1, F.lit(8)), 2, 10).cast("int"))), "")
    of_bits = runs.select("id", "run_no", F.length("run").alias("n_symbols"), bits.alias("bits")).select("id", "run_no", "n_symbols", F.inline(F.array(F.struct(F.lit("bits").alias("form"), chars(F.col("bits")).alias("decoded")), F.struct(F.lit("flipped").alias("form"), chars(F.translate("bits", "01", "10")).alias("decoded")))))
    tags = a.select("id", F.posexplode(F.regexp_extract_all("content", F.lit(TAG_RUN), F.lit(0))).alias("run_no", "run"))
    of_tags = tags.select("id", "run_no", F.length("run").alias("n_symbols"), F.lit("tags").alias("form"), F.translate("run", TAG_LETTERS, ASCII).alias("decoded"))
    return of_bits.unionByName(of_tags).select("id", "run_no", "n_symbols", "form", F.sha2("decoded", 256).alias("decoded_sha256"), F.regexp_replace("decoded", "[^ -~]", "?").alias("decoded"))


_CHARS = lambda b: f"array_to_string(list_transform(generate_series(0, length({b}) // 8 - 1), lambda i: chr(list_reduce(list_transform(string_split(substr({b}, (i * 8 + 1)::INT, 8), ''), lambda x: x::INT), lambda x, y: x * 2 + y)::INT)), '')"
SQL_HIDDEN = f"""WITH {SQL_ARTIFACTS}, runs AS (SELECT id, unnest(generate_series(0, len(regexp_extract_all(content, {quoted(RUN)})) - 1))::INT AS run_no, unnest(regexp_extract_all(content, {quoted(RUN)})) AS run FROM artifacts WHERE regexp_matches(content, {quoted(RUN)})),
s AS (SELECT id, run_no, run, list_sort(list_distinct(string_split(run, ''))) AS s FROM runs), b AS (SELECT id, run_no, length(run)::INT AS n_symbols, array_to_string(list_transform(string_split(run, ''), lambda c: CASE WHEN c = s[1] THEN '0' ELSE '1' END), '') AS bits FROM s WHERE len(s) = 2),
tags AS (SELECT id, unnest(generate_series(0, len(regexp_extract_all(content, {quoted(TAG_RUN)})) - 1))::INT AS run_no, unnest(regexp_extract_all(content, {quoted(TAG_RUN)})) AS run FROM artifacts WHERE regexp_matches(content, {quoted(TAG_RUN)})),
d AS (SELECT id, run_no, n_symbols, 'bits' AS form, {_CHARS("bits")} AS decoded FROM b UNION ALL SELECT id, run_no, n_symbols, 'flipped', {_CHARS("translate(bits, '01', '10')")} FROM b UNION ALL SELECT id, run_no, length(run)::INT, 'tags', translate(run, '{TAG_LETTERS}', {quoted(ASCII)}) FROM tags)
SELECT id, run_no, n_symbols, form, sha256(decoded) AS decoded_sha256, regexp_replace(decoded, '[^ -~]', '?', 'g') AS decoded FROM d"""

#: How encoded tokens look, 24 characters or more of each.
TOKENS = (
    ("base64", "\\b[A-Za-z0-9+/]{24,}={0,2}"),
    ("base64url", "\\b[A-Za-z0-9]*[_-][A-Za-z0-9_-]{23,}={0,2}"),
    ("hex", "\\b(?:[0-9a-fA-F]{2}){12,}\\b"),
    ("hex-escape", "(?:\\\\x[0-9a-fA-F]{2}){8,}"),
)
GZIP = "\\bH4sI[A-Za-z0-9+/]{20,}={0,2}"
ALPHABET, ROT13 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
#: Layers of encoding that are opened; characters of a piece of a compressed token's text, those that it shares
#: with the piece before, and bytes that are unpacked of one token.
LAYERS, PIECE, OVERLAP, MOST_BYTES = 3, 262_144, 4_096, 1 << 26


def unpacked(token: str) -> Iterator[tuple[str, bool]]:
    """The text of a compressed token, piece by piece, each with the end of the one before.

    At MOST_BYTES a last, empty piece says that the token holds more. A token that is broken or no text
    has the pieces before that place.
    """
    stream, text, held, total = zlib.decompressobj(31), codecs.getincrementaldecoder("utf-8")(), "", 0
    try:
        rest = base64.b64decode(token + "=" * (-len(token) % 4))
        while not stream.eof:
            if total >= MOST_BYTES:
                yield "", True
                return
            raw = stream.decompress(rest, PIECE)
            rest, total = stream.unconsumed_tail, total + len(raw)
            piece = text.decode(raw, stream.eof)
            if piece:
                yield held + piece, False
                held = (held + piece)[-OVERLAP:]
            if not raw and not rest:
                return
    except (ValueError, zlib.error):
        return


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, layer, token in zip(b["id"], b["layer"], b["token"].to_pylist(), strict=True):
            for piece, more in unpacked(token):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], b["id"].type), pa.array([layer.as_py()], pa.int32()), pa.array(["gzip"]), pa.array([piece]), pa.array([more])], names=["id", "layer", "encoding", "decoded", "truncated"])


def _text(kind, token):
    """What a token of a kind decodes to; null where it can't be."""
    plain = F.translate(F.regexp_replace(token, "=", ""), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    raw = (
        F.when((kind == "base64") & (F.length(token) % 4 == 0), F.try_to_binary(token, F.lit("base64")))
        .when((kind == "base64url") & (F.length(plain) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
        .when(kind == "hex", F.unhex(token))
        .when(kind == "hex-escape", F.unhex(F.replace(token, F.lit("\\x"), F.lit(""))))
    )
    return raw.cast("string")


def decoded(texts, layers: int = LAYERS):
    """Texts hidden in encoded tokens of texts (id, content), layer by layer: id, layer, encoding, decoded, truncated.

    A layer decodes what the one before revealed, all its tokens. Compressed ones are unpacked as a
    stream: a long text is several rows that overlap, and one that exceeds the limit ends with an empty
    row that is truncated.
    """
    kinds = [*TOKENS, ("gzip", GZIP)]

    def named(kind: str):
        return lambda t: F.struct(F.lit(kind).alias("encoding"), t.alias("token"))

    out, current = None, texts
    schema = f"id {texts.schema['id'].dataType.simpleString()}, layer int, encoding string, decoded string, truncated boolean"
    for layer in range(1, layers + 1):
        tokens = [F.transform(F.array_distinct(F.regexp_extract_all("content", F.lit(p), F.lit(0))), named(k)) for k, p in kinds]
        some = current.where(any_match(F.col("content"), [p for _, p in kinds]))
        found = rows_of(some.withColumn("layer", F.lit(layer)), ["id", "layer"], F.concat(*tokens), "token")
        plain = found.where("encoding <> 'gzip'").select("id", "layer", "encoding", _text(F.col("encoding"), F.col("token")).alias("decoded"), F.lit(False).alias("truncated")).where("is_valid_utf8(decoded)")
        level = plain.unionByName(found.where("encoding = 'gzip'").select("id", "layer", "token").mapInArrow(_unpacked, schema))
        out = level if out is None else out.unionByName(level)
        current = level.select("id", F.col("decoded").alias("content"))
    turned = texts.select("id", F.lit(1).alias("layer"), F.lit("rot13").alias("encoding"), F.translate("content", ALPHABET, ROT13).alias("decoded"), F.lit(False).alias("truncated"))
    return out.unionByName(turned)


def q_encoded(spark, sf_dir):
    """Encoded tokens, up to three layers deep, whose text carries a payload or was not read to its end: the rules run again on what was hidden."""
    found = decoded(artifacts(spark, sf_dir).select("id", "content"))
    return found.where(F.col("truncated") | any_match(F.col("decoded"), PAYLOADS))


_SQL_BYTES = {
    "base64": "CASE WHEN length(token) % 4 = 0 THEN from_base64(token) END",
    "base64url": "CASE WHEN length(rtrim(token, '=')) % 4 <> 1 THEN from_base64(rpad(translate(rtrim(token, '='), '-_', '+/'), (ceil(length(rtrim(token, '=')) / 4) * 4)::INT, '=')) END",
    "hex": "unhex(token)",
    "hex-escape": "unhex(replace(token, chr(92) || 'x', ''))",
}


def _sql_layer(n: int, source: str) -> str:
    """One layer; compressed tokens can't be opened in SQL."""
    tokens = " UNION ALL ".join(f"SELECT id, '{k}' AS encoding, unnest(list_distinct(regexp_extract_all(content, {quoted(p)}))) AS token FROM {source}" for k, p in TOKENS)
    made = " ".join(f"WHEN '{k}' THEN {e}" for k, e in _SQL_BYTES.items())
    return f"t{n} AS ({tokens}), d{n} AS (SELECT id, {n} AS layer, encoding, TRY(decode(CASE encoding {made} END)) AS content FROM t{n})"


SQL_ENCODED = f"""WITH {SQL_ARTIFACTS}, {", ".join(_sql_layer(n, "artifacts" if n == 1 else f"d{n - 1}") for n in range(1, LAYERS + 1))}, d AS ({" UNION ALL ".join(f"SELECT * FROM d{n}" for n in range(1, LAYERS + 1))} UNION ALL SELECT id, 1, 'rot13', translate(content, '{ALPHABET}', '{ROT13}') FROM artifacts)
SELECT id, layer, encoding, content AS decoded, false AS truncated FROM d WHERE content IS NOT NULL AND regexp_matches(content, {quoted(PAYLOAD)})"""

QUERIES = {
    "invisible_chars": (q_invisible, SQL_INVISIBLE),
    "homoglyphs": (q_homoglyphs, SQL_HOMOGLYPHS),
    "hidden_runs": (q_hidden_runs, SQL_HIDDEN),
    "encoded_payloads": (q_encoded, SQL_ENCODED),
}
