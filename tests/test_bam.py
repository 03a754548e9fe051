"""Binary alignments written here give the rows of the same alignments as text, for any split."""

import random
import struct
import zlib

import pytest

from cladewright.sources import bam, matrices

REFERENCES = ["chr1", "target"]


def blocked(data, size):
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(name, flag, ref, pos, cigar, seq, qual, tags):
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(k)) for n, k in cigar)
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq]
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2] + [0] * (len(codes) % 2), strict=True))
    quals = bytes(ord(q) - 33 for q in qual) if qual != "*" else b"\xff" * len(seq)
    extra = b""
    for t, kind, v in tags:
        raw = v.encode() + b"\0" if kind == "Z" else v.encode() if kind == "A" else struct.pack("<bi2h", *b"s", 2, *v) if kind == "B" else struct.pack({"i": "<i", "C": "<B", "f": "<f"}[kind], v)
        extra += t.encode() + kind.encode() + raw
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, 30, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + quals + extra
    return struct.pack("<i", len(body)) + body


def made(n, corrected=True):
    rng = random.Random(n)
    word = lambda k, letters="ACGTN": "".join(rng.choice(letters) for _ in range(k))
    raw, text = b"", "@HD\tVN:1.6\n"
    for i in range(n):
        k = rng.choice([0, 1, 7, 60, 300])
        name, seq, qual = f"C{i % 9}_U{i}_{i % 5}_f", word(k), word(k, "!+5?I") if rng.random() < 0.8 else "*"
        cigar = [(k, "M")] if k and i % 3 else []
        tags = [("CR", "Z", word(6)), ("UR", "Z", word(4)), ("AS", "i", -i), ("XC", "C", i % 200), ("XA", "A", "q"), ("XF", "f", 0.5), ("XB", "B", (i, -2))]
        if corrected and i % 4:
            tags.append(("CB", "Z", word(6)))
        ref, pos = (rng.randrange(2), rng.randint(1, 1 << 20)) if cigar else (-1, 0)
        raw += record(name, 16 * (i % 2), ref, pos, cigar, seq, qual if k else "*", tags)
        shown = {"Z": lambda v: f"Z:{v}", "i": lambda v: f"i:{v}", "C": lambda v: f"i:{v}", "A": lambda v: f"A:{v}", "f": lambda v: f"f:{v:g}", "B": lambda v: "B:s," + ",".join(map(str, v))}
        text += "\t".join([name, str(16 * (i % 2)), REFERENCES[ref] if cigar else "*", str(pos), "30", "".join(f"{a}{b}" for a, b in cigar) or "*", "*", "0", "0", seq or "*", qual if k else "*", *(f"{t}:{shown[kind](v)}" for t, kind, v in tags)]) + "\n"
    head = b"BAM\1" + struct.pack("<i", 10) + b"@HD\tVN:1.6" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 1 << 21) for r in REFERENCES)
    return head + raw, text


@pytest.mark.parametrize("block", [60_000, 700, 150])
def test_binary_equals_text_for_any_split(spark, tmp_path, block):
    raw, text = made(400)
    (tmp_path / "x.bam").write_bytes(blocked(raw, block))
    (tmp_path / "x.sam").write_text(text)
    want = sorted(map(str, matrices.read_sam(spark, str(tmp_path / "x.sam")).collect()))
    size = (tmp_path / "x.bam").stat().st_size
    for split in (1 << 26, size // 3 + 1, size // 11 + 1):
        df = bam.read_bam(spark, str(tmp_path / "x.bam"), split)
        assert sorted(map(str, df.collect())) == want
        assert df.rdd.getNumPartitions() == -(-size // split)


def test_corrected_barcodes_win(spark, tmp_path):
    for corrected, n in ((True, 75), (False, 100)):
        folder = tmp_path / str(corrected)
        folder.mkdir()
        (folder / "x.bam").write_bytes(blocked(made(100, corrected)[0], 5000))
        (folder / "empty.bam").write_bytes(blocked(made(0)[0], 5000))
        reads = bam.read_bam(spark, str(folder))
        got = bam.with_barcodes(reads)
        tag = "CB" if corrected else "CR"
        assert got.count() == n and got.filter(f"cellBC <> tags['{tag}'] or UMI <> tags['UR']").isEmpty()


def test_broken_files(spark, tmp_path):
    raw = made(50)[0]
    (tmp_path / "a.bam").write_bytes(b"nothing of the kind, whatever its name says")
    (tmp_path / "b.bam").write_bytes(blocked(raw[:-20], 900))
    for name in ("a.bam", "b.bam"):
        with pytest.raises(Exception, match="no block|not a BAM|ends within"):
            bam.read_bam(spark, str(tmp_path / name)).collect()
