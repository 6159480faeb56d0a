"""The manifest, the replay of filters and the archives against brute force, round trips and odd inputs."""

import gzip
import hashlib
import json
import random
import struct
import zipfile
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import interaction, merkle, warc
from tessera.llm import queries as Q
from tessera.llm.common import join_by_key

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, held int, pos int, part string"
TABLES = ("documents", "labels", "pages")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_filter_interaction", "op13_warc_packages"])
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    df = Q.QUERIES[name](spark, data)
    found = con.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_join_by_key_holds_hot_and_null_keys_apart(spark):
    big = spark.range(500).selectExpr("case when id % 3 = 0 then 7 when id % 50 = 1 then null else id end as k", "id as a")
    small = spark.createDataFrame([(7, "x"), (8, "y"), (400, "z"), (9999, "n")], "k long, b string")
    want = sorted((r["k"], r["a"], {7: "x", 8: "y", 400: "z"}.get(r["k"])) for r in big.collect() if r["k"] is not None)
    for limit in (10, 0):
        got = [tuple(r) for r in join_by_key(big, small, ["k"], limit, 20).collect()]
        assert sorted(r for r in got if r[0] is not None) == want and len(got) == 500 and all(b is None for k, _, b in got if k is None)


# --- 11


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, low=False):
    out = []
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if v is None:
            out.append("-")
            continue
        v = "".join(x.lower() if "A" <= x <= "Z" else x for x in str(v)) if low and c == "text" else str(v)
        out.append(f"{len(v.encode())}:{v}")
    return digest(*out)


def tree(nodes):
    """(root, for each node its siblings and places level by level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append((run, k % 16))
        level = [digest(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [k // 16 for k in at]
    return level[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] if r["doc_id"] is not None else -(10**18), leaf_of(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, leaf, r), path in zip(sorted(by[s], key=lambda x: x[:2]), trees[s][1]):
            path = path + top
            held = leaf_of(r, True) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else leaf
            for run, k in path:
                held = digest(*run[:k], held, *run[k + 1 :])
            out.append((r["doc_id"], leaf, trees[s][0], root, digest(*("".join(run[:k] + run[k + 1 :]) for run, k in path)), held, held == root))
    return Counter(out)


def manifest_rows(df):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def test_manifest_against_brute_force_on_odd_rows(spark):
    rng = random.Random(4)
    texts = [None, "", "ABC", "é È x", "plain", "a" * 100_000 + "B"]
    rows = [(rng.choice([None, i, i, i]), rng.choice(texts), rng.choice([None, "en"]), rng.choice([None, "", "s", "t", "é"]), rng.choice([None, i]), "g", 1, 2, "p") for i in range(300)]
    rows += [rows[5]] * 40 + [(None,) * 9] * 3
    rows += [(10_000 + i, f"T {i}", "en", f"only {i}", 1, None, None, None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    assert manifest_rows(merkle.audit(docs)) == brute_manifest([r.asDict() for r in docs.collect()])
    assert merkle.audit(docs.limit(0)).count() == 0
    one = docs.where("doc_id = 10001")
    assert manifest_rows(merkle.audit(one)) == brute_manifest([r.asDict() for r in one.collect()])


def test_manifest_of_many_blocks(spark):
    """Several blocks of a group, a last run of one, and more groups than a run has."""
    sizes = {"large": 2 * 4096 + 1, "block": 4096, "more": 4097, **{f"g{i:02}": i + 1 for i in range(18)}}
    rows = [(i, f"{s} {i} X", "en", s, 1, "", 0, 0, "") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS)
    got = manifest_rows(merkle.audit(docs))
    assert got == brute_manifest([dict(zip([c.split()[0] for c in DOCS.split(", ")], r)) for r in rows])
    assert merkle.levels_of(1) == 0 and merkle.levels_of(16) == 1 and merkle.levels_of(17) == 2 and merkle.levels_of(4097) == 4


def test_numbered_places_rows_over_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("case when id % 3 = 0 then 'hot' else concat('g', id % 11) end as g", "(id * 7919) % 1000 as v")
    by = defaultdict(list)
    for r in merkle.numbered(rows, "g", "v").collect():
        by[r["g"]].append((r["pos"], r["v"], r["size"]))
    for found in by.values():
        found.sort()
        assert [p for p, *_ in found] == list(range(len(found))) and [v for _, v, _ in found] == sorted(v for _, v, _ in found) and {n for *_, n in found} == {len(found)}


# --- 12


def brute_interaction(rows, labels):
    first = defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None:
            first[r["text"] or ""].append(r["doc_id"])
    good, toxic = ({x["doc_id"] for x in labels if x[c] == 1 and x["doc_id"] is not None} for c in ("quality", "toxic"))
    flagged = []
    for r in rows:
        t = r["text"] or ""
        words = [w for w in t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
        flags = {
            "A": len(words) < 50, "B": 100 * len({*words}) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": r["doc_id"] is not None and min(first[t]) < r["doc_id"],
        }
        flagged.append((r["source"] or "", flags, r["doc_id"] in good, r["doc_id"] in toxic))
    out, removed = {}, Counter()
    for part in {f[0] for f in flagged}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in flagged if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                now = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                out[part, order, step] = [len(left), len(now), sum(f[1][x] for f in gone), sum(f[1][x] and sum(f[1].values()) == 1 for f in flagged if f[0] == part), sum(f[2] for f in now), sum(f[3] for f in now)]
                removed[part, x] += len(now)
                gone += now
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interaction_against_brute_force_on_odd_rows(spark):
    rng = random.Random(8)
    words = ["one", "Two", "THREE", "é", "x$y", "five", "six", " seven"]
    texts = [None, "", " \n\t", "a b " * 40, "PIPE | " * 30, *[" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(12)], " ".join(f"w{i}" for i in range(30_000))]
    rows = [(rng.choice([None, i, i, i // 2]), rng.choice(texts), None, rng.choice([None, "", "s", "t"]), 1, "g", 1, 2, "clash") for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(rng.choice([None, i, i]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), "t") for i in range(100)] + [(3, 1, 0, "t"), (3, 0, 1, "t")], "doc_id long, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in interaction.audit(docs, labels).collect()}
    assert got == brute_interaction([r.asDict() for r in docs.collect()], [r.asDict() for r in labels.collect()])
    assert interaction.audit(docs.limit(0), labels).count() == 0
    assert interaction.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_orders_are_all_permutations(spark):
    rows = interaction.orders(spark).collect()
    assert len({r["filter_order"] for r in rows}) == 120 and all(r["filter_order"][r[f"at_{x}"] - 1] == x for r in rows for x in "ABCDE")


# --- 13


PAGES = "page_id long, url string, html string, package string, size int, record_type string"


def odd_pages(spark):
    same, small = "é" * 600, "s" * 999
    rows = [
        (1, "http://a/", same), (9, "http://b/", same), (4, None, same), (4, "http://b\r\nX: y/ z", same), (2, "http://c", small), (3, "http://d", small), (5, "u", None), (6, "", ""), (None, "http://e", same), (None, "n", "only" * 400), (7, "l", "x\r\n\r\n" * 50_000), (7, "l", "x\r\n\r\n" * 50_000),
        (8, "m", "A" * 1000), (10, "m", "A" * 1000), (10, "m", "A" * 1000),
    ]
    return spark.createDataFrame([(*r, "p", 1, "t") for r in rows], PAGES)


def brute_records(rows):
    first = {}
    for r in rows:
        h = (r["html"] or "").encode()
        if len(h) >= 1000 and r["page_id"] is not None:
            first[h] = max(r["page_id"], first.get(h, r["page_id"]))
    out = []
    for r in rows:
        h = (r["html"] or "").encode()
        to = first.get(h)
        again = to is not None and r["page_id"] != to
        out.append((r["page_id"], len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", to if again else None))
    return Counter(out)


def test_round_trip_of_odd_pages(spark, tmp_path):
    pages = odd_pages(spark)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, str(tmp_path / "a")).collect())
    assert got == brute_records([r.asDict() for r in pages.collect()])
    assert warc.round_trip(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_packages_are_zip_files_of_warc_records(spark, tmp_path):
    """What other readers find: ZIP members by zipfile, gzip members one after another, records with their fields."""
    pages = odd_pages(spark).coalesce(1)
    written = warc.write_packages(warc.deduplicated(pages, []), str(tmp_path / "out"), member_bytes=600, package_bytes=2500)
    files = [r["package"] for r in written.collect()]
    assert len(files) > 1 and written.agg(F.sum("records")).first()[0] == 15
    found = Counter()
    for path in files:
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            for name in z.namelist():
                if name.endswith(".warc.gz"):
                    body = z.read(name)
                    for line in z.read(name.replace("archive/", "indexes/").replace(".warc.gz", ".cdxj")).decode().splitlines():
                        x = json.loads(line)
                        record = gzip.decompress(body[x["offset"] : x["offset"] + x["length"]])
                        head = record.split(b"\r\n\r\n")[0].decode().split("\r\n")
                        assert head[0] == "WARC/1.1" and record.endswith(b"\r\n\r\n") and f"WARC-Type: {x['type']}" in head and f"WARC-Payload-Digest: {x['digest']}" in head
                        found[x["type"]] += 1
    assert found == Counter(r[3] for r in brute_records([r.asDict() for r in pages.collect()]).elements())
    # ranges alone, with payloads, and the same without an index
    read = warc.read_packages(written).collect()
    assert all(r["error"] is None for r in read)
    assert Counter(bytes(r["payload"]) for r in read if r["warc_type"] == "response") == Counter((r["html"] or "").encode() for r in warc.deduplicated(pages, []).where("record_type = 'response'").collect())
    bare = []
    for i, path in enumerate(files):
        bare.append(str(tmp_path / f"bare{i}.zip"))
        with zipfile.ZipFile(path) as z, zipfile.ZipFile(bare[-1], "w") as out:
            for name in z.namelist():
                if name.startswith("archive/"):
                    out.writestr(name, z.read(name))
    again = warc.read_packages(spark.createDataFrame([(p,) for p in bare], "package string")).collect()
    assert Counter((r["record_id"], r["payload_sha1"]) for r in again) == Counter((r["record_id"], r["payload_sha1"]) for r in read)


def test_zip64_directories_and_comments(tmp_path, monkeypatch):
    path = str(tmp_path / "z.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/0.warc.gz", b"abc")
    plain = warc.members_of(path)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = str(tmp_path / "w.zip")
    with zipfile.ZipFile(wide, "w") as z:
        for i in range(40):
            z.writestr(f"archive/{i}.warc.gz", bytes([i]) * (i + 3))
            z.writestr(f"é{i}.txt", b"")
        z.comment = b"PK\x05\x06 a comment that looks like a record " + b"x" * 3000
    raw = open(wide, "rb").read()
    assert warc.EOCD64 in raw and warc.LOCATOR64 in raw
    got = warc.members_of(wide)
    assert len(got) == 80 and not any(m["error"] for m in got) and got[1]["member"] == "é0.txt"
    for m in got[::2]:
        i = int(m["member"].split("/")[1].split(".")[0])
        assert raw[m["data_offset"] : m["data_offset"] + m["stored_size"]] == bytes([i]) * (i + 3) and m["size"] == i + 3
    (one,) = plain
    assert open(path, "rb").read()[one["data_offset"] :][:3] == b"abc"
    # the directory is read in small pieces as well
    with open(wide, "rb") as f:
        read = lambda at, n: (f.seek(at), f.read(n))[1]
        n = len(raw)
        place = warc.directory_place(read(n - 3100, 3100), n, read)
        assert [e[0] for e in warc.entries_of(read, *place, piece=7)] == [m["member"] for m in got]


def test_broken_packages_are_told_and_others_read(spark, tmp_path):
    good, cut, text, deflated, lying, empty = (str(tmp_path / f"{n}.zip") for n in ("good", "cut", "text", "deflated", "lying", "empty"))
    record = warc._gzip(warc.record_bytes("response", warc.record_id(1), "http://a", hashlib.sha1(b"hi").hexdigest(), None, b"hi"))
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("archive/0.warc.gz", record + warc._gzip(b"no record"))
        z.writestr("readme.txt", "x")
    body = open(good, "rb").read()
    open(cut, "wb").write(body[: len(body) // 2])
    open(text, "w").write("no zip at all")
    open(empty, "w").close()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/0.warc.gz", b"a" * 1000)
    at = body.rfind(warc.EOCD)
    open(lying, "wb").write(body[: at + 16] + struct.pack("<I", 10**6) + body[at + 20 :])
    rows = warc.read_packages(spark.createDataFrame([(p,) for p in (good, cut, text, deflated, lying, empty, str(tmp_path / "none.zip"), None)], "package string")).collect()
    wrong = Counter(r["package"].rsplit("/", 1)[1] for r in rows if r["error"])
    assert wrong == Counter({f"{n}.zip": 1 for n in ("good", "cut", "text", "deflated", "lying", "empty", "none")})
    (fine,) = [r for r in rows if not r["error"]]
    assert bytes(fine["payload"]) == b"hi" and fine["record_id"] == "<urn:page:1>"


def test_runs_of_neighbouring_ranges():
    spots = [(0, 10), (10, 5), (20, 5), (25, 100), (125, 1)]
    assert list(warc.runs_of(spots, 50)) == [(0, 15, [0, 1]), (20, 5, [2]), (25, 100, [3]), (125, 1, [4])]
    assert warc.file_system("file:/a/b")[1] == "/a/b" and warc.file_system("file:///a/b")[1] == "/a/b" and warc.file_system("/a")[1] == "/a"
