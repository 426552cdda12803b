"""Files read, split over tasks, refused and written back."""

import gzip

import pytest
from atom_tables import ids
from pyspark.sql import functions as F

from atomframe.operators import prep
from atomframe.sources import catalog, grids, lines, structures

PDB = """HEADER    TEST
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 10.00           N
ATOM      2  CA AALA A   1      11.639   6.071  -5.147  0.30 11.00           C
ATOM      3  CA BALA A   1      11.700   6.100  -5.200  0.70 12.00
HETATM    4 ZN    ZN A 101A     -1.000   2.000   3.500  1.00 13.00          ZN
ENDMDL
ATOM      1  N   ALA A   1      99.000   6.134  -6.504  1.00 10.00           N
"""

CIF = """data_TEST
#
loop_
_pdbx_struct_assembly_gen.assembly_id
_pdbx_struct_assembly_gen.oper_expression
_pdbx_struct_assembly_gen.asym_id_list
1 '1,2' A,B
2 3 A
#
loop_
_pdbx_struct_oper_list.id
_pdbx_struct_oper_list.matrix[1][1]
_pdbx_struct_oper_list.matrix[1][2]
_pdbx_struct_oper_list.matrix[1][3]
_pdbx_struct_oper_list.vector[1]
_pdbx_struct_oper_list.matrix[2][1]
_pdbx_struct_oper_list.matrix[2][2]
_pdbx_struct_oper_list.matrix[2][3]
_pdbx_struct_oper_list.vector[2]
_pdbx_struct_oper_list.matrix[3][1]
_pdbx_struct_oper_list.matrix[3][2]
_pdbx_struct_oper_list.matrix[3][3]
_pdbx_struct_oper_list.vector[3]
1 1 0 0 0 0 1 0 0 0 0 1 0
2 -1 0 0 10.5 0 -1 0 0 0 0 1 0
3 1 0 0 0 0 1 0 0 0 0 1 7
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.B_iso_or_equiv
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_model_num
ATOM 1 N N . DA A 1 ? 1.0 2.0 3.0 1.00 5.0 10 X 1
ATOM 2 C "C1'" A DA A 1 ? 2.0 2.0 3.0 0.50 5.0 10 X 1
HETATM 3 O O . HOH B . ? 3.0 2.0 3.0 1.00 5.0 301 X 1
ATOM 1 N N . DA A 1 ? 9.0 2.0 3.0 1.00 5.0 10 X 2
#
_tail.x 1
"""


def write(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_pdb(spark, tmp_path):
    atoms = structures.read_pdb(spark, write(tmp_path, one__pdb=PDB, two__ent=PDB.replace("ALA", "GLY")))
    rows = atoms.filter("structure_id = 'one'").orderBy("rank").collect()
    assert [(r["atom_name"], r["altloc_id"], r["element"], r["rank"]) for r in rows] == [
        ("N", ".", "N", 0), ("CA", "A", "C", 1), ("CA", "B", "C", 2), ("ZN", ".", "ZN", 3),
    ]
    assert rows[3]["hetero"] and (rows[3]["res_id"], rows[3]["ins_code"], rows[3]["x"]) == (101, "A", -1.0)
    assert atoms.filter("structure_id = 'two' AND res_name = 'GLY'").count() == 3
    assert ids(prep.resolve_conformers(atoms.filter("structure_id = 'one'"))) == [1, 3, 4]


def test_pdb_with_a_broken_number_names_it(spark, tmp_path):
    path = write(tmp_path, bad__pdb=PDB.replace("11.104", "1x.104"))
    with pytest.raises(Exception, match="cannot read coordinate x"):
        structures.read_pdb(spark, path).collect()


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    text = "\n".join(f"line {i} {'x' * (i % 50)}" for i in range(5000))
    (tmp_path / "big.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = lines.read_lines(spark, str(tmp_path))
        assert got.select(F.spark_partition_id()).distinct().count() >= 1
        ordered = [r["value"] for r in got.orderBy("line_no").collect()]
        assert got.select("line_no").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ordered == text.split("\n")


def test_mmcif_and_its_assembly(spark, tmp_path):
    path = write(tmp_path, t__cif=CIF)
    atoms = structures.read_mmcif(spark, path)
    rows = atoms.orderBy("rank").collect()
    assert [(r["atom_name"], r["altloc_id"], r["chain_id"], r["res_id"]) for r in rows] == [
        ("N", ".", "X", 10), ("C1'", "A", "X", 10), ("O", ".", "X", 301),
    ]
    assert rows[2]["label_seq_id"] is None and rows[2]["label_asym_id"] == "B" and rows[2]["hetero"]
    ops = structures.read_assembly_ops(spark, path)
    assert ops.count() == 4
    built = prep.expand_assembly(atoms, ops, chain_column="label_asym_id")
    assert sorted(built.filter("atom_id = 1").select("sym_id", "x").collect()) == [(0, 1.0), (1, 9.5)]


def test_cif_is_a_stream_of_values(spark, tmp_path):
    """Wrapped rows, texts in semicolons, comments, pairs over lines and two blocks."""
    folders = [tmp_path / c for c in "abcde"]
    for folder in folders:
        folder.mkdir()
    plain = [tuple(r) for r in structures.read_mmcif(spark, write(folders[0], t__cif=CIF)).orderBy("rank").collect()]
    wrapped = CIF.replace("1.00 5.0 301", "1.00 # half\n\n5.0\n301")
    assert [tuple(r) for r in structures.read_mmcif(spark, write(folders[1], t__cif=wrapped)).orderBy("rank").collect()] == plain
    note = "\n_note.text\n;loop_\n_atom_site.id\ndata_no\n;\n"
    two = CIF.replace("data_TEST", "data_one") + note + wrapped.replace("data_TEST", "data_two")
    got = structures.read_mmcif(spark, write(folders[2], t__cif=two)).orderBy("structure_id", "rank").collect()
    assert [r["structure_id"] for r in got] == ["t-one"] * 3 + ["t-two"] * 3
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in plain] * 2
    pairs = "data_x\n_n.a 'b c'\n_n.d\n;first\n second # no comment\n;\n_n.e # a comment\n \"q # r\"\n_other.x 1\n"
    found = structures.cif_rows(lines.read_lines(spark, write(folders[3], n__cif=pairs)), "n").collect()
    assert [(r["tags"], r["tokens"]) for r in found] == [({"a": 0, "d": 1, "e": 2}, ["b c", "first\n second # no comment", "q # r"])]
    with pytest.raises(Exception, match="ends early"):
        structures.read_mmcif(spark, write(folders[4], t__cif=CIF.replace("1.00 5.0 301", "1.00 5.0"))).collect()


def test_numbers_in_base_36(spark):
    rows = {"99999": 99999, "A0000": 100000, "ZZZZZ": 43770015, "a0000": 43770016, "zzzzz": 87440031, " -12 ": -12, "Ab000": None, "": None}
    found = spark.createDataFrame([(t,) for t in rows], "t string").select("t", structures.hybrid36(F.col("t"), 5).alias("n")).collect()
    assert {r["t"]: r["n"] for r in found} == rows


def test_operator_products(spark, tmp_path):
    text = CIF.replace("1 '1,2' A,B", "1 '(1-60)(61-88)' A")
    head, tail = text.split("_pdbx_struct_oper_list.vector[3]\n")
    rows = "".join(f"{k} 1 0 0 {k} 0 1 0 0 0 0 1 0\n" for k in range(1, 89))
    path = write(tmp_path, t__cif=f"{head}_pdbx_struct_oper_list.vector[3]\n{rows}{tail[tail.index('#'):]}")
    ops = structures.read_assembly_ops(spark, path).collect()
    assert sorted(r["op_id"] for r in ops) == list(range(1, 1681))
    assert sorted(r["tx"] for r in ops) == sorted(float(a + b) for a in range(1, 61) for b in range(61, 89))


def test_mmcif_export_round_trip(spark, mixed, tmp_path):
    odd = mixed.withColumn("atom_name", F.when(F.col("atom_id") == 5, "C1'").otherwise(F.col("atom_name")))
    structures.write_mmcif(odd, str(tmp_path / "out"))
    back = structures.read_mmcif(spark, f"{tmp_path}/out/*/*/*.txt")
    cols = ["atom_id", "chain_id", "res_id", "res_name", "atom_name", "element", "hetero", "altloc_id", "b_factor", "x", "y", "z"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, odd.select(cols).collect()))


def test_texts_in_parts_are_read_as_one_file(spark, mixed, tmp_path):
    named = mixed.withColumn("structure_id", F.lit("a b:1+c"))
    both = named.unionByName(mixed.withColumn("structure_id", F.lit("2xyz")))
    out = tmp_path / "cif"
    structures.write_mmcif(both, str(out), part_lines=7)  # 19 lines of header, 9 of atoms
    assert len(list(out.glob("file=2xyz/part=*"))) == 4
    cols = ["structure_id", "rank", "atom_id", "chain_id", "res_id", "atom_name", "x", "y", "z"]
    for path in (str(out), f"{out}/*/*/*.txt"):
        back = structures.read_mmcif(spark, path)
        assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, both.select(cols).collect()))
    with pytest.raises(ValueError, match="not whole"):
        structures.read_mmcif(spark, f"{out}/*/part=[123]/*.txt")
    with pytest.raises(ValueError, match="not whole"):
        structures.read_mmcif(spark, f"{out}/file=2xyz/part=[013]/*.txt")
    grid = spark.range(60).selectExpr(
        "'g' AS structure_id", "CAST(id DIV 20 AS INT) AS i", "CAST(id DIV 5 % 4 AS INT) AS j",
        "CAST(id % 5 AS INT) AS k", "CAST(id AS DOUBLE) AS value",
    )
    meta = spark.sql("SELECT 'g' AS structure_id, 3L AS nx, 4L AS ny, 5L AS nz, 0D AS ox, 0D AS oy, 0D AS oz, 1D AS hx, 1D AS hy, 1D AS hz")
    grids.write_dx(grid, meta, str(tmp_path / "dx"), part_lines=5)
    _, values = grids.read_dx(spark, str(tmp_path / "dx"))
    assert sorted(map(tuple, values.collect())) == sorted(map(tuple, grid.collect()))


def test_export_cannot_label_part_of_a_model(spark, mixed):
    with pytest.raises(ValueError, match="whole number"):
        structures.tile_altlocs(mixed, mixed.limit(4))


def test_a3m(spark, tmp_path):
    path = write(tmp_path, q__a3m=">query\nACD\nEF\n>hit one\nA-gkD\n\nEF\n")
    rows = grids.read_a3m(spark, path).orderBy("seq_idx", "col").collect()
    text = {s: "".join(r["letter"] for r in rows if r["seq_idx"] == s) for s in (0, 1)}
    assert text == {0: "ACDEF", 1: "A-DEF"} and [r["col"] for r in rows] == [0, 1, 2, 3, 4] * 2


def test_pqr(spark, tmp_path):
    path = write(tmp_path, a__pqr="REMARK\nATOM 1 N ALA A 1 1.0 2.0 3.0 -0.5 1.8\nATOM x y\nHETATM 2 ZN ZN 4.0 5.0 6.0 2.0 1.1\n")
    rows = grids.read_pqr(spark, path, strict=True).orderBy("atom_id").collect()
    assert [(r["charge"], r["radius"], r["x"]) for r in rows] == [(-0.5, 1.8, 1.0), (2.0, 1.1, 4.0)]
    (tmp_path / "b.pqr").write_text("REMARK nothing\n")
    with pytest.raises(ValueError, match="no atoms"):
        grids.read_pqr(spark, path, strict=True)


def grid_of(spark, shape):
    nx, ny, nz = shape
    rows = [("g", i, j, k, float(i * 100 + j * 10 + k)) for i in range(nx) for j in range(ny) for k in range(nz)]
    grid = spark.createDataFrame(rows, "structure_id string, i int, j int, k int, value double")
    meta = spark.createDataFrame([("g", -1.0, 2.0, 0.5, *shape, 0.5, 1.0, 2.0)], "structure_id string, ox double, oy double, oz double, nx long, ny long, nz long, hx double, hy double, hz double")
    return grid, meta


def test_grid_text_round_trip_is_not_transposed(spark, tmp_path):
    grid, meta = grid_of(spark, (2, 3, 4))
    grids.write_dx(grid, meta, str(tmp_path / "dx"))
    text = grids.dx_lines(grid, meta).orderBy("line_no").collect()
    assert text[8]["value"] == "0.000000e+00 1.000000e+00 2.000000e+00" and len(text) == 8 + 8 + 5
    back_meta, back = grids.read_dx(spark, f"{tmp_path}/dx/*/*/*.txt")
    m = back_meta.collect()[0]
    assert (m["nx"], m["ny"], m["nz"], m["ox"], m["hz"]) == (2, 3, 4, -1.0, 2.0)
    cols = ["i", "j", "k", "value"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, grid.select(cols).collect()))


@pytest.mark.parametrize("change, message", [
    (lambda t: t.replace("counts 2 3 4", "counts 2 3 5"), "not the declared one"),
    (lambda t: t.replace("origin", "# origin"), "definition is missing"),
])
def test_damaged_grids_are_refused(spark, tmp_path, change, message):
    grid, meta = grid_of(spark, (2, 3, 4))
    text = "\n".join(r["value"] for r in grids.dx_lines(grid, meta).orderBy("line_no").collect())
    (tmp_path / "g.dx").write_text(change(text))
    with pytest.raises(Exception, match=message):
        grids.read_dx(spark, str(tmp_path))[0].collect()


def test_volume_files(spark, tmp_path):
    mrc = b"x" * 208 + b"MAP " + b"y" * 40
    files = {
        "a.map": mrc, "b.map.gz": gzip.compress(mrc), "mislabelled.cube": mrc, "c.dx": b"# c\nobject 1", "d.CUB": b"cube text",
        "e.foo": b"?", "g.map.gz": gzip.compress(b""), "h.map.gz": b"\x1f\x8bbroken", "emd.bcif": b"b",
        "cut.map.gz": gzip.compress(mrc * 900)[:-9], "two.map.gz": gzip.compress(mrc) + gzip.compress(b"more"),
        "x" + ".a" * 70 + ".map": b"?",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in catalog.catalog_volumes(spark, str(tmp_path)).collect()}
    assert {n: r["format"] for n, r in got.items()} == {
        "a.map": "ccp4", "b.map.gz": "ccp4", "mislabelled.cube": "ccp4", "c.dx": "dx", "d.CUB": "cube",
        "e.foo": None, "g.map.gz": None, "h.map.gz": None, "emd.bcif": "dscif",
        "cut.map.gz": None, "two.map.gz": "ccp4", "x" + ".a" * 70 + ".map": "ccp4",
    }
    assert got["b.map.gz"]["was_compressed"] and got["g.map.gz"]["problem"] == "is empty"
    assert "decompress" in got["h.map.gz"]["problem"]
    blank = spark.createDataFrame([("f.map", bytearray())], "path string, content binary")
    assert catalog.classify_volumes(blank).collect()[0]["problem"] == "is empty"
    with pytest.raises(ValueError):
        catalog.catalog_volumes(spark, str(tmp_path), "mrc2")
    with pytest.raises(Exception, match="cannot use volume file"):
        catalog.catalog_volumes(spark, str(tmp_path), strict=True).collect()


def test_identifiers(spark):
    wanted = spark.createDataFrame([(" 1UBQ ",), ("P69905",), ("/d/x.PDB",), ("nope",), ("4HHB",)], "identifier string")
    held = spark.createDataFrame([("4hhb",)], "name string")
    got = {r["identifier"].strip(): (r["kind"], r["name"]) for r in catalog.resolve_ids(wanted, held).collect()}
    assert got == {"1UBQ": ("pdb", "1ubq"), "P69905": ("alphafold", "AF-P69905"), "/d/x.PDB": ("file", "x"), "nope": ("error", None)}


def test_pqr_lines_are_split_once(spark):
    """The numbers are counted in a written table, not in lines that each step splits again."""
    lines = spark.createDataFrame(
        [("/in/a.pqr", 2, "ATOM 1 N ALA 1 1.0 2.0 3.0 0.5 1.5"), ("/in/a.pqr", 4, "ATOM 1.0 2.0"), ("/in/a.pqr", 6, "ATOM 1 x 1 1 NaN 1 1"),
         ("/in/a.pqr", 9, "HETATM 7 O HOH A 9 4 5 6 -1 1.2")], "file string, line_no long, value string")
    found = grids.parse_pqr(lines)
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.orderBy("atom_id").collect()]
    assert got == [("a", 1, 1.0, 2.0, 3.0, 0.5, 1.5), ("a", 2, 4.0, 5.0, 6.0, -1.0, 1.2)]


def test_values_of_a_stream_are_cut_into_rows_without_a_row_for_each(spark):
    """Values come as arrays of a line; rows of seven end inside lines, and one line holds several rows."""
    sizes = [3, 4, 1, 13, 7, 2, 19]
    values = iter(range(1000))
    texts = [" ".join(f"v{next(values)}" for _ in range(n)) for n in sizes]
    body = spark.createDataFrame([("f", 10 * i, t) for i, t in enumerate(texts)], "file string, line_no long, value string")
    stream = structures._stream(body)
    assert stream.count() == len(sizes)
    found = structures._rows_of(stream.withColumn("_width", F.lit(7)), F.col("_width"))
    got = {r["row"]: r["tokens"] for r in found.collect()}
    assert got == {n: [f"v{7 * n + k}" for k in range(7)] for n in range(7)}
    with pytest.raises(Exception, match="a row ends early: v48"):
        structures._rows_of(stream.withColumn("_width", F.lit(8)), F.col("_width")).collect()


def test_reals_near_their_decimals_are_written_as_the_formatter_writes_them(spark):
    values = [0.0, -0.0, -0.0004, 0.0005, 1.0005, -1.0005, 2.675, 1e-9, 12.3, -12.345, 999999.999, 4e9, 1e12, 1e15, 123456789.0004999, float("nan"), float("inf")]
    values += [k / 1000 for k in range(-2500, 2500, 7)] + [k / 1000 + 0.00025 for k in range(-50, 50)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    text = structures._decimals("v", 3)
    for r in df.select("v", text.alias("got"), F.format_string("%.3f", "v").alias("want")).collect():
        assert r["got"] == r["want"], r["v"]


def test_texts_that_need_quotes_are_found_together(spark):
    texts = ["A", "", "C1'", 'x"y', "a b", "_x", "#1", "$", "[", ";", "O5*", "1_555", "a;b"]
    names = spark.createDataFrame(list(enumerate(texts)), "atom_id long, atom_name string")
    rows = names.selectExpr(
        "1L structure_id", "*", "'C' element", "'.' altloc_id", "'ALA' res_name", "'A' chain_id", "CAST(atom_id AS INT) res_id",
        "'' ins_code", "false hetero", "1D x", "2D y", "3D z", "1D occupancy", "0D b_factor",
    )
    lines = [r["value"] for r in structures.mmcif_lines(rows).orderBy("line_no").collect() if r["value"].startswith("ATOM")]
    want = [r["t"] for r in names.orderBy("atom_id").select(structures._cif_token(F.col("atom_name")).alias("t")).collect()]
    assert [line.split(" C ", 1)[1].split(" . ALA", 1)[0] for line in lines] == want
