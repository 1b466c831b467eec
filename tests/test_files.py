import gzip
import sqlite3
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from gramwright import cli
from gramwright.codec import bcor as codec
from gramwright.codec import bgen as bgen_codec
from gramwright.codec import blocks
from gramwright.operators.standardize import standardize_array
from gramwright.plans import flows
from gramwright.operators import projection
from gramwright.sources import bcor, bgen, blockmatrix, files, tables, text, variant_index


def matrix(n, seed=0, unit=True):
    x = np.random.default_rng(seed).normal(size=(n * 3, n))
    m = np.corrcoef(x.T)
    return m if unit else m * 0.97


def upper(spark, m):
    i, j = np.triu_indices(len(m))
    return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), m[i, j].tolist())), "i int, j int, r double")


def info(spark, n, chrom="01"):
    return spark.createDataFrame([(k, f"rs{k}", chrom, 100 + k, "A", "GT"[k % 2]) for k in range(n)], "variant_idx int, rsid string, chrom string, pos int, ref string, alt string")


def back(df, n):
    out = np.full((n, n), np.nan)
    for r in df.collect():
        out[r[0], r[1]] = out[r[1], r[0]] = np.nan if r[2] is None else r[2]
    return out


@pytest.mark.parametrize("width", [1, 2, 4, 8])
def test_codes(width):
    r = np.array([-1.5, -1, -0.3, 0, 0.7, 1, 2.3, np.nan])
    codes = codec.encode(r, width)
    assert codes[-1] == codec.missing(width) and codes[0] == 0 and codes[-2] == codec.missing(width) - 1
    assert codes[5] == 2 * codec.shift(width)
    near = codec.decode(codes, width)
    assert np.isnan(near[-1]) and np.allclose(near[1:6], r[1:6], atol=2.0 ** -(8 * width - 3) + 1e-7)


def test_records_are_strict():
    record = codec.meta_record(3, "rs1", "01", 77, "A", "GG")
    assert codec.read_meta(record) == (3, "rs1", 77, "01", "A", "GG")
    for bad in (record[:-1], record + b"x", record[:3]):
        with pytest.raises(ValueError):
            codec.read_meta(bad)


@pytest.mark.parametrize("level,unit", [(0, True), (1, True), (2, False), (3, True)])
def test_store_round_trip(spark, tmp_path, level, unit):
    n = 9
    m = matrix(n, unit=unit)
    m[1, 4] = m[4, 1] = np.nan
    path = str(tmp_path / "a.bcor")
    bcor.write(upper(spark, m), info(spark, n), path, 50, level)
    header = bcor.header_of(path)
    assert header.extended is not unit and header.n_samples == 50 and header.file_size == (tmp_path / "a.bcor").stat().st_size
    got = back(bcor.full_matrix(spark, path), n)
    assert np.array_equal(np.isnan(got), np.isnan(m))
    assert np.nanmax(np.abs(got - m)) < [2e-2, 1e-4, 1e-6, 1e-6][level]
    cells, rows = bcor.read_by_rsid(spark, path, ["rs5", "rs2", "rs5"], ["rs2"])
    assert back(cells, 3)[0, 0] == pytest.approx(got[5, 2]) and [r["chromosome"] for r in rows.collect()] == ["01"] * 3
    part = bcor.table(spark, path).where("i >= 3 and i < 5")
    assert part.count() == (n - 4) + (n - 5)
    assert bcor.table(spark, path, "header").first()["has_index"]


def test_index_faults(spark, tmp_path):
    path = str(tmp_path / "a.bcor")
    bcor.write(upper(spark, matrix(4)), info(spark, 4), path, write_index=False)
    with pytest.raises(RuntimeError):
        bcor.read_by_rsid(spark, path, ["rs0"])
    bcor.make_index(path)
    with pytest.raises(FileExistsError):
        bcor.make_index(path)
    data = (tmp_path / "a.bcor.idx").read_bytes()
    assert codec.read_index(data).rsids == ["rs0", "rs1", "rs2", "rs3"]
    for bad in (b"x" + data[1:], data[:30], data[:-1], data[:8] + struct.pack("<I", 9) + data[12:]):
        with pytest.raises(ValueError):
            codec.read_index(bad)
    with open(path, "ab") as f:
        f.write(b"more")
    assert bcor.index_of(path) is None
    with pytest.raises(ValueError):
        codec.make_index(["a", "a"], [32, 40, 50], codec.Header(False, 0, 1, 2, 1, 50))


@pytest.mark.parametrize("name,form", [("m.ld", "matrix"), ("m.ld.gz", "matrix"), ("m.ld", "long"), ("m.ld.bgz", "long")])
def test_text_round_trip(spark, tmp_path, name, form):
    m, path = matrix(5, unit=False), str(tmp_path / name)
    text.write(upper(spark, m), path, form, info(spark, 5))
    ld, meta = text.read(spark, path)
    assert np.allclose(back(ld, 5), m, atol=1e-6)
    rows = meta.orderBy("variant_idx").collect()
    assert [r["rsid"] for r in rows] == [f"rs{k}" for k in range(5)]
    if form == "long":
        assert rows[0]["chrom"] == "01" and rows[3]["pos"] == 103


def test_long_without_info(spark, tmp_path):
    path = tmp_path / "old.ld"
    path.write_text("#VAR1\tVAR2\tR\n0\t1\t0.5\n")
    assert back(text.read(spark, str(path))[0], 2).tolist() == [[1, 0.5], [0.5, 1]]
    path.write_text("#VAR1\tVAR2\tR\n")
    assert back(text.read(spark, str(path))[0], 1).tolist() == [[1]]
    with pytest.raises(ValueError):
        text.write(spark.createDataFrame([], "i int, j int, r double"), str(path), "long")
    text.write(upper(spark, np.array([[1.0, np.nan], [np.nan, 1.0]])), str(path), "matrix")
    assert path.read_text() == "1.000000\tnan\nnan\t1.000000\n"


def block_store(tmp_path, m, size=3, drop=()):
    root = tmp_path / "m.bm"
    (root / "parts").mkdir(parents=True)
    n = -(-len(m) // size)
    numbers, names = [], []
    for bj in range(n):
        for bi in range(bj + 1):
            if (bi, bj) in drop:
                continue
            part = m[bi * size : (bi + 1) * size, bj * size : (bj + 1) * size]
            names.append(f"part-{len(names)}")
            numbers.append(bi + bj * n)
            (root / "parts" / names[-1]).write_bytes(blocks.write_block(np.triu(part) if bi == bj else part, by_row=bool(bi)))
    (root / "metadata.json").write_text(__import__("json").dumps({"blockSize": size, "nRows": len(m), "nCols": len(m), "maybeFiltered": numbers, "partFiles": names}))
    return str(root)


def index(spark, path, n):
    rows = [("1", 10 * k, "A", "G", k) for k in range(n)]
    variant_index.write(spark.createDataFrame(rows, "contig string, position int, ref string, alt string, idx int"), path)


def test_block_matrix_extract(spark, tmp_path):
    m = matrix(7)
    store, at = block_store(tmp_path, m, drop=[(0, 2)]), str(tmp_path / "v.parquet")
    index(spark, at, 7)
    z = tmp_path / "x.z"
    z.write_text("RSID Chromosome position allele1 allele2\na 1 50 G A\nb 1 10 A G\nc 1 11 A G\n")
    found, targets = flows.extract_ld(spark, store, at, str(tmp_path / "o"), z=str(z), output_format="both")
    assert [(r["rsid"], r["flipped"]) for r in targets.orderBy("ord").collect()] == [("a", True), ("b", False)]
    assert np.allclose(back(found, 2)[0, 1], -m[1, 5])
    assert np.allclose(np.load(tmp_path / "o.npz")["matrix"], [[1, -m[1, 5]], [-m[1, 5], 1]])
    found, _ = flows.extract_ld(spark, store, None, str(tmp_path / "p"), idx_range=(0, 7))
    got = back(found, 7)
    assert np.isnan(got[0, 6]) and np.allclose(got[:6, :6], m[:6, :6])
    assert cli.main(["--ld-bm", "--bm", store, "--variant-index", at, "--region", "1:10-30", "--fill", "zero", "--out", str(tmp_path / "q")], spark) == 0
    assert np.allclose(back(bcor.full_matrix(spark, str(tmp_path / "q.bcor")), 3), m[1:4, 1:4], atol=1e-4)
    with pytest.raises(ValueError):
        flows.extract_ld(spark, store, at, str(tmp_path / "r"), region="1:1-2", idx_range=(0, 1))
    with pytest.raises(ValueError):
        flows.extract_ld(spark, store, None, str(tmp_path / "r"), region="1:1-2")


def test_index_needs_two_alleles(spark):
    t = spark.createDataFrame([(("1", 5), ["A", "C", "G"], 0)], "locus struct<contig:string,position:int>, alleles array<string>, idx int")
    with pytest.raises(ValueError):
        variant_index.from_locus_table(t)


def write_bgen(path, g, layout=2, compression=1, bits=8, missing=()):
    """g: samples x variants of 0, 1, 2."""
    n, v = g.shape
    names = b"".join(struct.pack("<H", len(f"s{k}")) + f"s{k}".encode() for k in range(n))
    flags = compression | layout << 2 | 1 << 31
    head = struct.pack("<III4sI", 20, v, n, b"bgen", flags)
    block = struct.pack("<II", 8 + len(names), n) + names
    out = bytearray(struct.pack("<I", len(head) + len(block)) + head + block)
    places = []
    for k in range(v):
        at = len(out)
        s = lambda x, c: struct.pack(c, len(x)) + x.encode()
        if layout == 1:
            out += struct.pack("<I", n)
        out += s(f"id{k}", "<H") + s(f"rs{k}", "<H") + s("01", "<H") + struct.pack("<I", 10 * k + 10)
        if layout == 2:
            out += struct.pack("<H", 2)
        out += s("A", "<I") + s("G", "<I")
        p = np.stack([g[:, k] == 0, g[:, k] == 1, g[:, k] == 2], 1)
        if layout == 1:
            raw = (p * 32768).astype("<u2").tobytes()
            packed = zlib.compress(raw)
            out += struct.pack("<I", len(packed)) + packed
        else:
            ploidy = bytes(0x82 if (i, k) in missing else 2 for i in range(n))
            values = p[:, :2].astype(np.uint64) * ((1 << bits) - 1)
            flat = ((values.reshape(-1, 1) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            raw = struct.pack("<IHBB", n, 2, 2, 2) + ploidy + bytes([0, bits]) + np.packbits(flat, bitorder="little").tobytes()
            packed = zlib.compress(raw) if compression == 1 else pa.Codec("zstd").compress(raw).to_pybytes() if compression == 2 else raw
            out += struct.pack("<II", len(packed) + 4, len(raw)) + packed if compression else struct.pack("<I", len(raw)) + raw
        places.append((at, len(out) - at, "01", 10 * k + 10, f"rs{k}", "A", "G"))
    path.write_bytes(bytes(out))
    db = sqlite3.connect(str(path) + ".bgi")
    db.execute("CREATE TABLE Variant (chromosome TEXT, position INT, rsid TEXT, number_of_alleles INT, allele1 TEXT, allele2 TEXT, file_start_position INT, size_in_bytes INT)")
    db.executemany("INSERT INTO Variant (file_start_position, size_in_bytes, chromosome, position, rsid, allele1, allele2) VALUES (?,?,?,?,?,?,?)", places)
    db.commit()
    db.close()


@pytest.mark.parametrize("layout,compression,bits", [(1, 1, 16), (2, 0, 8), (2, 1, 10), (2, 2, 16)])
def test_bgen_dosages(tmp_path, layout, compression, bits):
    g = np.random.default_rng(1).integers(0, 3, (7, 3))
    write_bgen(tmp_path / "a.bgen", g, layout, compression, bits)
    data = (tmp_path / "a.bgen").read_bytes()
    header = bgen_codec.read_header(data)
    assert bgen_codec.read_samples(data, header) == [f"s{k}" for k in range(7)]
    at = header.offset
    for k in range(3):
        v, at = bgen_codec.read_variant(data, at, header)
        assert v.rsid == f"rs{k}" and np.allclose(bgen_codec.dosages(data[v.data_at : v.data_at + v.data_length], header), g[:, k])


def test_ld_from_bgen(spark, tmp_path):
    g = np.random.default_rng(2).integers(0, 3, (40, 5))
    bgen = tmp_path / "a.bgen"
    write_bgen(bgen, g, missing=[(3, 2)])
    out = str(tmp_path / "o")
    assert cli.main(["--compute-ld", "--bgen", str(bgen), "--out", out], spark) == 1  # a missing dosage
    assert cli.main(["--compute-ld", "--bgen", str(bgen), "--out", out, "--nan-action", "omit", "--output-format", "long"], spark) == 0
    z = standardize_array(np.delete(g, 3, 0))[0]
    ld, meta = flows.load(spark, out + ".ld.gz")
    assert np.allclose(back(ld, 5), z.T @ z, atol=1e-6) and meta.first()["chrom"] == "01"
    cov = tmp_path / "c.txt"
    r = np.random.default_rng(5)
    x = r.normal(size=40)
    cov.write_text("IID\tPC1\tsex\n" + "".join(f"s{k}\t{x[k]}\t{'mf'[k % 2]}\n" for k in reversed(range(40)) if k != 7))
    zf = tmp_path / "v.z"
    zf.write_text("rsid chromosome position allele1 allele2\nrs1 01 20 A G\nrs4 01 50 A G\n")
    base = ["--compute-ld", "--bgen", str(bgen), "--z", str(zf), "--nan-action", "mean", "--output-format", "bcor"]
    assert cli.main([*base, "--out", out, "-c", str(cov), "--save-projection"], spark) == 0
    keep = [k for k in range(40) if k != 7]
    z = standardize_array(g[keep][:, [1, 4]])[0]
    q, _ = np.linalg.qr(np.column_stack([x[keep], [k % 2 == 0 for k in keep], np.ones(39)]))
    res = z - q @ (q.T @ z)
    assert np.allclose(back(bcor.full_matrix(spark, out + ".bcor"), 2), res.T @ res, atol=1e-4)
    again = str(tmp_path / "again")
    assert cli.main([*base, "--out", again, "--projection-matrix", out + ".proj"], spark) == 0
    assert (tmp_path / "again.bcor").read_bytes() == (tmp_path / "o.bcor").read_bytes()
    (tmp_path / "a.bgen.bgi").unlink()
    assert cli.main([*base, "--out", out], spark) == 1


@pytest.mark.parametrize("argv", [[], ["--compute-ld"], ["--precompute-projection"], ["--compute-ld", "--bgen", "x", "--output-format", "npz"], ["--compute-ld", "--bgen", "x", "-c", "a", "--projection-matrix", "b"], ["--ld-bm"], ["--ld-bm", "--bm", "x", "--idx-range", "0:1", "--storage-options", "[1]"], ["--precompute-projection", "-c", "a", "--bgen", "b"], ["--compute-ld", "--bgen", "x", "--save-projection"]])
def test_flags(argv):
    assert cli.main([*argv, "--out", "/tmp/unused"]) == 1


def test_covariate_files(spark, tmp_path):
    for name, sep, opened in (("a.csv", ",", open), ("a.tsv", "\t", open), ("a.csv.gz", ",", gzip.open), ("a.csv.bgz", ",", gzip.open)):
        path = str(tmp_path / name)
        with opened(path, "wt") as f:
            f.write(sep.join(["IID", "x", "t"]) + "\n" + sep.join(["007", "1.5", "a"]) + "\n" + sep.join(["8", "NA", "b"]) + "\n")
        got = sorted(map(tuple, tables.covariates(spark, path).collect()))
        assert got == [("007", 1.5, "a"), ("8", None, "b")]
    with pytest.raises(ValueError):
        tables.covariates(spark, path, "FID")
    with pytest.raises(ValueError):
        tables.covariates(spark, str(tmp_path / "none.csv")).count()
    p = tmp_path / "d.sample"
    p.write_text("ID_1 ID_2 missing\n0 0 0\n5 5 0\n3 3 0\n")
    assert [tuple(r) for r in tables.samples(spark, str(p)).orderBy("sample_pos").collect()] == [("5", 0), ("3", 1)]


def test_lookups_read_little(spark, tmp_path, monkeypatch):
    """Opening takes the header; two rows of 400 take two ranges of records."""
    n = 400
    path = str(tmp_path / "a.bcor")
    bcor.write(upper(spark, matrix(3)).where("i < j"), info(spark, n), path, n_variants=n)
    read = []
    plain = files.read_ranges
    monkeypatch.setattr(files, "read_ranges", lambda at, ranges, options=None: (read.extend(ranges), plain(at, ranges, options))[1])
    one = files.read_range
    opened = []
    monkeypatch.setattr(files, "read_range", lambda at, a, b, options=None: (opened.append(b - a), one(at, a, b, options))[1])
    header = bcor.header_of(path)
    index = bcor.index_of(path, header)
    assert opened == [codec.HEADER.size]
    found = bcor.records_of(path, index, [3, 390], gap=8)
    assert found[390] == (490, "01", "A", "G") and len(read) == 2 and sum(b - a for a, b in read) == sum(int(index.offsets[k + 1] - index.offsets[k]) for k in (3, 390))
    read.clear()
    bcor.records_of(path, index, [3, 390], gap=1 << 16)
    assert len(read) == 1


def test_bands_are_written_apart(spark, tmp_path, monkeypatch):
    m = matrix(40)
    whole, parts = str(tmp_path / "a.bcor"), str(tmp_path / "b.bcor")
    bcor.write(upper(spark, m), info(spark, 40), whole)
    monkeypatch.setattr(bcor, "BAND", 100)
    assert len(bcor._bands(40)) > 5 and len(bcor._bands(0)) == len(bcor._bands(1)) == 1
    bcor.write(upper(spark, m), info(spark, 40), parts)
    assert (tmp_path / "a.bcor").read_bytes() == (tmp_path / "b.bcor").read_bytes()
    monkeypatch.setattr(files, "local", lambda path: None)
    bcor.write(upper(spark, m), info(spark, 40), str(tmp_path / "c.bcor"))
    assert (tmp_path / "a.bcor").read_bytes() == (tmp_path / "c.bcor").read_bytes()
    bcor.write(upper(spark, m).limit(0), None, str(tmp_path / "d.bcor"))
    assert bcor.table(spark, str(tmp_path / "d.bcor")).count() == 0


def test_bgen_round_trip(spark, tmp_path):
    d = np.array([[0, 1, 2, 0.25], [2, 1.5, np.nan, 0]])
    rows = spark.createDataFrame([(k, f"rs{k}", "1", 10 * k + 10, "A", "G", d[k].tolist()) for k in range(2)], bgen.SCHEMA)
    path = str(tmp_path / "g" / "a.bgen")
    bgen.write(rows, ["a", "b", "c", "d"], path)
    assert bgen.sample_ids(path) == ["a", "b", "c", "d"]
    got = np.array([r["dosage"] for r in bgen.read(spark, path).orderBy("variant_idx").collect()])
    assert np.allclose(got, d, atol=2e-5, equal_nan=True)
    assert bgen.places(spark, path, listed=[("1", 20), ("2", 10)]).count() == 1


def test_projection_as_npz(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", float(k % 3), float(k % 5)) for k in range(20)], "sample_id string, x double, y double")
    p = projection.basis(rows)
    back_ = tables.load_projection(spark, tables.save_projection(p, str(tmp_path / "q.proj.npz")))
    assert back_.names == p.names and back_.metadata == p.metadata
    assert {r[0]: r[1] for r in back_.q.collect()} == {r[0]: r[1] for r in p.q.collect()}


def test_index_from_the_command_line(spark, tmp_path):
    path = str(tmp_path / "a.bcor")
    bcor.write(upper(spark, matrix(4)), info(spark, 4), path, write_index=False)
    assert cli.main(["--index-bcor", path], spark) == 0 and bcor.index_of(path).rsids[3] == "rs3"
    assert cli.main(["--index-bcor", path], spark) == 1 and cli.main(["--index-bcor", path, "--force"], spark) == 0
