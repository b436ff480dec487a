"""Imaging files that the tests write: ranges, pushed conditions, damage, and a whole run."""

import uuid
import zlib

import numpy as np
import pytest

from ionlake.plans import config, pipeline
from ionlake.sources import imaging, readers

KINDS = {"<f4": "MS:1000521", "<f8": "MS:1000523", "<i4": "MS:1000519"}


def write(folder, spectra, shared=None, mz_type="<f8", inten_type="<f4", packed=False, tic=True, name="a"):
    """``spectra``: (x, y, mz, inten); ``shared``: the m/z array of all."""
    own = uuid.uuid4()
    binary, entries = bytearray(own.bytes), []

    def put(values, kind):
        raw = np.asarray(values, kind).tobytes()
        raw = zlib.compress(raw) if packed else raw
        at = len(binary)
        binary.extend(raw)
        return at, len(values), len(raw)

    all_mz = put(shared, mz_type) if shared is not None else None
    term = lambda accession, value="": f'<cvParam cvRef="X" accession="{accession}" name="n" value="{value}"/>'
    for i, (x, y, mz, inten) in enumerate(spectra):
        arrays = ""
        for group, (at, n, size) in (("mz", all_mz or put(mz, mz_type)), ("inten", put(inten, inten_type))):
            arrays += f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{group}"/>{term(imaging.OFFSET, at)}{term(imaging.LENGTH, n)}{term(imaging.ENCODED, size)}<binary/></binaryDataArray>'
        total = term(imaging.TIC, float(np.sum(inten))) if tic else ""
        entries.append(f'<spectrum id="s{i}" index="{i}" defaultArrayLength="0">{total}<scanList count="1"><scan>{term(imaging.X, x)}{term(imaging.Y, y)}</scan></scanList><binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>')
    group = lambda name, array, kind: f'<referenceableParamGroup id="{name}">{term(array)}{term(KINDS[kind])}{term(imaging.ZLIB) if packed else ""}</referenceableParamGroup>'
    head = f'<?xml version="1.0" encoding="ISO-8859-1"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><fileDescription><fileContent>{term(imaging.UUID, "{" + str(own) + "}")}</fileContent></fileDescription><referenceableParamGroupList count="2">{group("mz", imaging.MZ_ARRAY, mz_type)}{group("inten", imaging.INTENSITY_ARRAY, inten_type)}</referenceableParamGroupList><run id="r"><spectrumList count="{len(spectra)}">'
    path = folder / f"{name}.imzML"
    path.write_bytes((head + "\n".join(entries) + "</spectrumList></run></mzML>").encode("latin-1"))
    (folder / f"{name}.ibd").write_bytes(binary)
    return str(path)


def made(n=60, points=40, seed=0):
    rng = np.random.default_rng(seed)
    return [(i % 8 + 3, i // 8 + 5, np.sort(rng.uniform(500, 900, points)).round(4), rng.integers(0, 4, points).astype(float)) for i in range(n)]


def events(df):
    return sorted(tuple(r) for r in df.select("frame", "x", "y", "mz", "inten").collect())


def expected(spectra, keep=lambda f, x, y, mz: True):
    return sorted((f, x, y, float(m), float(v)) for f, (x, y, mz, inten) in enumerate(spectra) for m, v in zip(mz, inten, strict=True) if v > 0 and keep(f, x, y, m))


@pytest.mark.parametrize("packed, range_bytes", [(False, 1 << 20), (False, 700), (True, 3000), (False, 17)])
def test_events_of_any_ranges(spark, tmp_path, packed, range_bytes):
    spectra = made(20 if range_bytes < 100 else 60)
    path = write(tmp_path, spectra, packed=packed)
    if range_bytes < 100:  # ranges smaller than an element, without Spark
        header, size = imaging.read_header(path)
        found = [s.frame for a in range(header.end, size, range_bytes) for s in imaging.spectra(path, header, a, min(a + range_bytes, size))]
        assert found == list(range(20))
        return
    df = imaging.read(spark, path, range_bytes=range_bytes)
    assert events(df) == expected(spectra)
    frames = imaging.read(spark, path, "frames", range_bytes)
    assert sorted(map(tuple, frames.collect())) == [(f, x, y, float(inten.sum())) for f, (x, y, _, inten) in enumerate(spectra)]


def test_conditions_reach_the_files(spark, tmp_path):
    spectra = made()
    path = write(tmp_path, spectra, tic=False)
    df = imaging.read(spark, path, range_bytes=4000)
    asked = df.where("mz >= 600 and mz < 650 and x in (4, 5) and y > 6 and frame <= 40")
    assert events(asked) == expected(spectra, lambda f, x, y, m: 600 <= m < 650 and x in (4, 5) and y > 6 and f <= 40)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan  # the source has taken every condition
    assert events(df.where("inten > 2 and mz > 700")) == [r for r in expected(spectra, lambda f, x, y, m: m > 700) if r[4] > 2]
    frames = imaging.read(spark, path, "frames").where("x = 3")
    assert sorted(tuple(r) for r in frames.collect()) == [(f, x, y, float(inten.sum())) for f, (x, y, _, inten) in enumerate(spectra) if x == 3]


def test_a_window_reads_its_bytes_alone(tmp_path):
    mz = np.linspace(500, 900, 4001)
    spectra = [(i, 0, mz, np.ones(4001)) for i in range(30)]
    path = write(tmp_path, spectra, shared=mz)
    reader = imaging.ImagingReader(path, "events", 1 << 20)
    taken = [imaging.GreaterThanOrEqual(("mz",), 700.0), imaging.LessThanOrEqual(("mz",), 701.0), imaging.EqualTo(("y",), 0), imaging.LessThan(("x",), 10)]
    assert list(reader.pushFilters([*taken, imaging.EqualTo(("inten",), 1.0)])) == [imaging.EqualTo(("inten",), 1.0)]
    opened = []
    own = imaging.Arrays
    try:
        imaging.Arrays = lambda *a: opened.append(own(*a)) or opened[-1]
        (part,) = reader.partitions()
        (batch,) = reader.read(part)
    finally:
        imaging.Arrays = own
    assert set(batch.column("frame").to_pylist()) == set(range(10)) and batch.num_rows == 110
    assert opened[0].read == 16 + mz.nbytes + 10 * 11 * 4  # the identity, the shared array once, ten windows


def test_faults_are_told(spark, tmp_path):
    path = write(tmp_path, made(3))
    data = tmp_path / "a.ibd"
    whole = data.read_bytes()
    data.write_bytes(b"\0" * 16 + whole[16:])
    with pytest.raises(Exception, match="belongs to another index"):
        imaging.read(spark, path).collect()
    data.write_bytes(whole[:-8])
    with pytest.raises(Exception, match="before an array's end"):
        imaging.read(spark, path).collect()
    (tmp_path / "b.imzML").write_text("<mzML></mzML>")
    with pytest.raises(Exception, match="no list of spectra"):
        imaging.read(spark, f"{tmp_path}/b.imzML").collect()
    none = write(tmp_path, [], name="none")
    assert imaging.read(spark, none).count() == 0


def test_a_run_takes_an_imaging_file(spark, tmp_path):
    from tests.test_run import PEPTIDES, _acquisition

    (tmp_path / "parquet").mkdir()
    _acquisition(spark, tmp_path / "parquet")
    rows = spark.read.parquet(f"{tmp_path}/parquet/events.parquet").toPandas().sort_values(["frame", "mz"])
    place = {r.frame: (r.x, r.y) for r in spark.read.parquet(f"{tmp_path}/parquet/frames.parquet").collect()}
    path = write(tmp_path, [(*place[f], g.mz.to_numpy(), g.inten.to_numpy()) for f, g in rows.groupby("frame")], inten_type="<i4")
    out = tmp_path / "out"
    c = config.load(None, events=path, psms=f"{tmp_path}/parquet/psms.tsv", output_dir=str(out), decoy_seeds=[0], tic_quantile=0.0, mz_range=[300.0, 3000.0])
    info = pipeline.run(spark, c)
    assert info["n_targets"] == len(PEPTIDES) and info["n_decoys"] >= 4
    scored = readers.read_results(spark, str(out))["rows"].toPandas()
    assert scored[~scored.is_decoy].s0.mean() > scored[scored.is_decoy].s0.mean()
    own = sorted((r.frame, r.mz, float(r.inten)) for r in spark.read.parquet(f"{tmp_path}/parquet/events.parquet").collect())
    assert sorted(tuple(r) for r in readers.read_events(spark, path).collect()) == [r for r in own if r[2] > 0]
