"""Secret scan: fixed patterns, and novelty under a primed compressor.

Base kinds are found by pattern: assign (a named secret given a value), access (a cloud access key id) and hex (a
long run of hex digits). The method's own kind, novel, looks at every other long unbroken run of key characters,
letters alone excepted, that stands within ``CONTEXT`` characters after a word of sensitive meaning. Its novelty is what it adds to a
zstandard frame: size(ballast + around + run) - size(ballast + around), in bits for each character, under a dictionary
trained on compounds of identifier words: strings of them, and the entropy tables of their letters and matches. A run is
measured as its words: lower-cased, a border where a capital follows a small letter, as identifiers are spelled in
either way. The ballast is plain text that pays for a frame's headers, so the difference is the run's alone. Text that
repeats its surroundings, or that is spelled from identifiers, costs three to five bits a character; random keys cost six
to eight. Runs of ``NOVEL_BITS`` or more are reported; the threshold was fitted on half of the identifiers and random keys
that tests/llm/test_scans.py makes, and holds on the other half. Runs of letters alone are not looked at, however novel: long words that the primer lacks cost as much as
random letters ("Geschwindigkeitsbegrenzung" and "qzvkxwmtplrhbncd"), so no threshold tells them apart.
A key of letters alone that no base pattern covers is neither reported nor redacted.

Results: a null text is an empty text, without spans. Positions are code points, the end is exclusive. Spans of
one kind don't overlap; spans of different kinds may. A novel run that lies inside a base span is not reported
again. Ties of start are ordered by kind, as KINDS lists them.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
CONTEXT, AROUND = 48, 160
NOVEL_BITS = 5.8
MIN_RUN = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_NAMES = re.compile(r"passw|secret|token|api_?key", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(r"credential|authori[sz]ation|bearer|private.?key|access.?key|secret|token|passw|api.?key|signature|client.?id|session", re.A | re.I)
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}", re.A)

# Words that identifiers in code, paths and configuration are made of.
_PRIMER_WORDS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization bearer basic credential credentials session session_id cookie signature certificate username user_name "
    "account account_id config configuration settings environment variable default value string integer boolean return "
    "function class import from export const static public private protected final void null none true false self this "
    "new if else for while try except catch throw raise assert print printf println logger logging warning error errors info "
    "debug trace level message messages request response header headers content type types application json http https "
    "localhost example examples com org net edu www index page pages home path paths file files filename directory name names "
    "version versions description author license data database table tables column columns row rows connection connect "
    "timeout retry retries endpoint region bucket object key keys id ids url urls uri host hosts hostname port ports server "
    "servers service services client clients internal external global local share usr bin etc var opt lib libs lib64 include "
    "src source sources test tests testing factory builder loader manager handler provider controller adapter wrapper helper "
    "utils util utility common core main base abstract interface implementation impl instance module modules package packages "
    "plugin plugins extension component components element elements node nodes tree list array map set dict dictionary hash "
    "queue stack heap buffer cache cached caching pool thread threads process processes processor worker workers task tasks job "
    "jobs schedule scheduler event events listener callback hook hooks signal signals action actions command commands option "
    "options argument arguments parameter parameters input output result results status state states code codes count counter "
    "number numbers index indices size length width height depth limit limits max maximum min minimum average total sum start "
    "end begin first last next previous current parent child children root leaf left right top bottom front back up down read "
    "reader write writer open close load save store stored storage fetch get put post delete remove add append insert update "
    "create created make build run running execute execution call caller init initialize initial setup teardown register "
    "registry resolve resolver parse parser format formatter encode encoder encoding decode decoder decoding compress "
    "decompress encrypt encrypted encryption decrypt decryption cipher digest random generate generated generator validate "
    "validation validator verify verified verification check checker checks compare match matches matcher filter filters sort "
    "sorted order search find replace split join merge copy clone move rename swap convert converter transform translate map "
    "reduce group batch stream streams streaming channel socket sockets protocol network address addresses proxy gateway router "
    "route routes routing load balancer cluster partition replica shard backup backups restore archive snapshot log logs history "
    "record records entry entries item items field fields property properties attribute attributes metadata schema model models "
    "view views template templates layout style theme color colour image images icon font text texts title label labels button "
    "form menu window dialog panel screen display render renderer visible hidden enabled disabled enable disable active inactive "
    "valid invalid required optional unique primary foreign temporary temp tmp permanent read_only readonly writable locked lock "
    "unlock mutex semaphore async await sync future promise wait sleep time times timer timestamp date dates day days month "
    "months year years hour minute second seconds zone utc duration interval period age expire expires expired expiry expiration "
    "user users group groups role roles permission permissions policy policies rule rules admin administrator owner member "
    "members customer customers order orders product products price payment payments invoice billing email mail phone contact "
    "subscription notification notifications subject body attachment queue topic consumer producer broker publish publisher "
    "subscribe subscriber login logout signin signup register authenticate authenticated authentication authorize authorized "
    "oauth oauth2 saml ldap sso jwt csrf cors ssl tls rsa aes sha256 md5 hmac salt nonce pem cert certs ca trust trusted root "
    "refresh access identity issuer audience scope scopes claim claims grant grants redirect callback state challenge verifier "
    "platform system systems device devices driver drivers memory disk cpu gpu kernel process signal exit exception exceptions "
    "failure failed fail success successful ok unknown undefined missing found not and or the with without of in on at to by as "
    "is are was has have can could should must will do does done any all some each every other only also than then when where "
    "which who how what why here there now always never before after between under over into out off test mock stub fake dummy "
    "sample placeholder changeme your_token_here development staging production prod dev qa release debug_mode feature flag "
    "flags toggle experiment metric metrics monitor monitoring alert alerts health report reports reporter analytics tracker "
    "tracking graph chart dashboard pipeline workflow stage stages step steps phase docker container containers image kubernetes "
    "namespace pod deployment terraform ansible jenkins github gitlab bitbucket repository repo branch commit merge pull push tag "
    "diff patch issue project projects workspace organization organisation team department company address city country language "
    "locale currency unit units scale ratio percent rate rates score weight weights vector matrix tensor layer layers learning "
    "training dataset datasets feature features label predict prediction classify classifier cluster embedding tokenizer "
    "vocabulary sequence pattern patterns regex expression expressions statement statements variable variables constant "
    "constants symbol symbols operator operators operand literal iterator iterable collection container pointer reference "
    "references address offset position location coordinates latitude longitude point points line lines area polygon shape "
    "getenv environ process.env system.getenv begin rsa private key end certificate multi single double float long short byte "
    "bytes char character characters bit bits mask flag unicode utf8 ascii base64 hex binary decimal octal signed unsigned "
    "header footer section sections chapter paragraph document documents content contents summary detail details overview "
    "background foreground preview thumbnail upload uploads download downloads transfer request_id correlation trace_id span "
    "0123456789 2019 2020 2021 2022 2023 2024 2025 2026 abcdefghijklmnopqrstuvwxyz"
)

#: Stands before every measured run.
_BALLAST = "client secret configuration and environment of the user "
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
DICTIONARY_BYTES, COMPOUNDS = 16_384, 6_000


@functools.cache
def dictionary() -> bytes:
    """The trained dictionary; equal in every process, as its compounds come from a fixed seed."""
    rnd, words, samples = random.Random(7), list(dict.fromkeys(_PRIMER_WORDS.lower().split())), []
    for _ in range(COMPOUNDS):
        compound = rnd.choices(words, k=rnd.randrange(2, 5))
        if rnd.random() < 0.15:
            compound.append(str(rnd.randrange(30)))
        lead = "the credential " if rnd.random() < 0.3 else ""
        samples.append(f"{lead}{'_'.join(compound)} is".encode())
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=6, level=19).as_bytes()


def _compressor(primer: bytes | None = None) -> zstandard.ZstdCompressor:
    shape = zstandard.ZstdCompressionParameters.from_level(19, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(primer or dictionary()), compression_params=shape)


def _spelled(run: str) -> str:
    return _HUMP.sub("_", run).lower()


def novelty(run: str, around: str, compressor: zstandard.ZstdCompressor) -> float:
    """Marginal compressed bits for each character of ``run``, given what stands around it."""
    before = (_BALLAST + _spelled(around) + " ").encode(errors="surrogatepass")
    inside = _spelled(run).encode(errors="surrogatepass")
    added = len(compressor.compress(before + inside)) - len(compressor.compress(before))
    return 8 * added / max(len(run), 1)


def find(text: str, compressor: zstandard.ZstdCompressor) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, spans the method adds) as (start, end, kind)."""
    base = []
    if _ASSIGN_NAMES.search(text):
        base += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    added = []
    if _SENSITIVE.search(text):
        taken = sorted(base)
        i = reach = 0
        for m in _RUN.finditer(text):
            a, b = m.span()
            if not _SENSITIVE.search(text, max(0, a - CONTEXT), a):
                continue
            while i < len(taken) and taken[i][0] <= a:
                reach = max(reach, taken[i][1])
                i += 1
            if b > reach and not m[0].isalpha() and novelty(m[0], text[max(0, a - AROUND) : a] + text[b : b + AROUND], compressor) >= NOVEL_BITS:
                added.append((a, b, "novel"))
    return base, added


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel: one row for each row of ``docs``."""

    primer = dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(primer)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                base, added = find(value.as_py() or "", compressor)
                kinds = [k for *_, k in base]
                row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added))
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(cols))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def redact(text: str, compressor: zstandard.ZstdCompressor) -> str:
    """``text`` with each reported span, overlapping ones merged, replaced by [SECRET]."""
    base, added = find(text, compressor)
    out, at = [], 0
    for a, b, _ in sorted(base + added):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with every secret in text replaced; a null text stays null.

    A column n_chars, where there is one, is set to the new length where the text was changed.
    """
    schema, names, primer = docs.schema, docs.columns, dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(primer)
        for batch in batches:
            at = names.index("text")
            old = batch.column(at).to_pylist()
            new = [None if t is None else redact(t, compressor) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if a is None or a == b else len(b) for n, a, b in zip(columns[k].to_pylist(), old, new, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)
