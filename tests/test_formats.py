"""Round trips, known answers and damaged input of the byte-level formats."""

import random
from datetime import datetime
from time import process_time

import pytest

from reliquary.functions import codecs as C
from reliquary.functions import resources as R
from reliquary.functions.encoders import lzhuf, lzw, squeeze
from reliquary.sources import containers as W
from reliquary.sources import disks as D
from reliquary.sources import volumes as V

rng = random.Random(1)
TEXT = bytes(rng.choices(b"abc \r\n\x90", k=5000))
NOISE = rng.randbytes(3000)


def a_file(name="ReadMe", data=TEXT, rsrc=NOISE, **more):
    return W.file(name=name, data_fork=data, rsrc_fork=rsrc, type_code="TEXT", creator_code="ttxt", **more)


def test_known_answers():
    assert C.crc16(b"123456789") == 0x31C3 and C.crc16(b"") == 0 and C.crc16(bytes(128)) == 0
    assert C.unpack_bits(b"\x01AB\xfeC") == b"ABCCC" and C.unpack_bits(b"\xfc\xaa") == b"\xaa" * 5
    assert C.unpack_bits(b"\x80\0A") == b"A" and C.unpack_bits(b"\x81\xff") == b"\xff" * 128
    assert C.unpack_bits(b"\xfe") == b"" and C.unpack_bits(b"\x02A") == b"A" and C.unpack_bits(b"\xfe\xff", 2) == b"\xff\xff"
    assert C.unsqueeze(b"\x76\xffB\0test.txt\0\0\0") == (b"", "test.txt")
    assert V.twelve_bits(b"\xab\xcd\xef") == [0xABC, 0xDEF]
    assert W.mac_date(2082844800) == datetime(1970, 1, 1) and W.mac_date(0) is None
    assert b"Hello\xd2".decode("mac_roman") == "Hello“"
    assert R.version(b"\x07\x53\x80\0\0\0\x057.5.3\0") == {"major": 7, "minor": 5, "fix": 3, "stage": "release", "short": "7.5.3", "long": ""}
    assert R.string(b"\x05Hello") == "Hello" and R.strings(b"\0\x02\x03abc\x02xy") == ["abc", "xy"] and R.strings(b"\0\0") == []
    assert R.code(b"\0\x04\0\x08") == {"first": 4, "count": 8}
    assert R.color_table(bytes(6) + b"\0\0" + b"\0\0\xff\xff\0\0\0\0") == [{"index": 0, "r": 0xFFFF, "g": 0, "b": 0}]


@pytest.mark.parametrize("data", [b"", b"a", TEXT, NOISE, b"\x90" * 700, b"x" * 1000])
def test_codecs_round_trip(data):
    assert C.unpack_bits(C.pack_bits(data)) == data
    assert C.unrepeat(C.repeat(data)) == data


def test_lzhuf():
    assert [sum(n == k for _, n in C.position_codes()) for k in range(3, 9)] == [1, 3, 8, 12, 24, 16]
    for data in (TEXT[:800], NOISE[:400], b"ab" * 300):
        assert C.unlzhuf(lzhuf(data), len(data)) == data
    long = bytes(rng.choices(b"etaoin", k=35_000))  # beyond the halving of counts
    tree, bits = C.AdaptiveTree(), []
    for b in long:
        bits += tree.path(b)
        tree.add(b)
    packed = int("".join(map(str, bits)).ljust(len(bits) + -len(bits) % 8, "0"), 2).to_bytes((len(bits) + 7) // 8, "big")
    assert C.unlzhuf(packed, len(long)) == long


def test_lzw():
    for data in (TEXT[:4096], TEXT[:100], NOISE):
        assert C.unlzw(lzw(data), len(data), 1) == data and C.unlzw(lzw(data, 2), len(data), 2) == data
    assert C.unlzw(b"\0\x03\0abc", 3, 2) == b"abc"


def test_squeeze():
    assert C.unsqueeze(squeeze(TEXT)) == (TEXT, None)
    assert C.unsqueeze(squeeze(b"hi", "name")) == (b"hi", "name")


def test_wrappers():
    f = a_file(finder_flags=0x2100, created=datetime(1991, 5, 6), modified=datetime(1997, 1, 2, 3, 4, 5))
    for version in (1, 2, 3):
        data = W.write_macbinary(f, version)
        assert W.identify(data) == "macbinary" and W.macbinary_version(data) == version and W.read_macbinary(data) == f
    assert W.is_macbinary(W.write_macbinary(a_file(data=b"12345", rsrc=b"")) + bytes(384))
    assert W.identify(b"some text") is None and W.identify(b"some text", "x.BIN") == "macbinary"
    assert not W.is_macbinary(W.write_macbinary(a_file(data=b"", rsrc=b"")))
    bare = f | {"created": None, "modified": None}
    assert W.identify(W.write_binhex(f)) == "binhex" and W.read_binhex(W.write_binhex(f)) == bare
    for order in ("big", "little"):
        assert W.read_apple(W.write_apple_single(f, order)) == f and W.identify(W.write_apple_single(f, order)) == "applesingle"
    two = W.write_binary_ii([("A.TXT", 6, 0x2000, TEXT), ("DIR", 0x0F, 0, b""), ("B", 4, 0, b"xyz")])
    assert [(x["name"], x["type_code"], x["creator_code"], x["data_fork"]) for x in W.unwrap(two)] == [("A.TXT", "$06", "$2000", TEXT), ("B", "$04", "$0000", b"xyz")]
    link = W.write_apple_link([("L", 6, 1, TEXT, NOISE), ("M", 4, 2, b"m", b"")])
    assert [(x["name"], x["data_fork"], x["rsrc_fork"]) for x in W.unwrap(link)] == [("L", TEXT, NOISE), ("M", b"m", b"")]
    assert W.prodos_date(0, 0) is None
    assert W.prodos_date((97 << 9) | (2 << 5) | 31, (10 << 8) | 30) == datetime(1997, 3, 3, 10, 30)


FILES = [a_file("ONE", b"1" * 700, b""), a_file("TWO", b"second", b""), a_file("THREE", NOISE[:2560], b"")]


def contents(files):
    return [(f["name"], f["data_fork"]) for f in files]


def test_volumes():
    want = contents(FILES)
    mfs = V.write_mfs("Test1", [a_file("A", TEXT, NOISE), a_file("B", b"", b"r" * 5000), a_file("C", b"c", b"")])
    assert V.filesystem_of(mfs) == "mfs" and V.mfs_volume(mfs)["name"] == "Test1"
    assert [(f["name"], f["data_fork"], f["rsrc_fork"]) for f in V.read_mfs(mfs)] == [("A", TEXT, NOISE), ("B", b"", b"r" * 5000), ("C", b"c", b"")]
    tree = b"T" * 600 + bytes(140_000) + b"end"
    prodos = V.write_prodos("VOL", [*FILES, a_file("TREE", tree, b""), a_file("EXT", b"d" * 900, b"rr"), a_file("SUB/IN", b"inner", b"")], 600)
    assert V.filesystem_of(prodos) == "prodos"
    assert {f["name"]: (f["data_fork"], f["rsrc_fork"]) for f in V.read_prodos(prodos)} == {**{n: (d, b"") for n, d in want}, "TREE": (tree, b""), "EXT": (b"d" * 900, b"rr"), "SUB/IN": (b"inner", b"")}
    whole = [(n, d + bytes(-len(d) % 256)) for n, d in want]
    for per_track in (16, 13):
        dos = V.write_dos(FILES, per_track)
        assert V.filesystem_of(dos) == "dos33" and contents(V.read_dos(dos)) == whole
    cpm = V.write_cpm([a_file("HELLO.COM", NOISE[:1280], b""), a_file("BIG.TXT", TEXT * 4, b"")])
    assert V.filesystem_of(cpm) == "cpm" and contents(V.read_cpm(cpm)) == [("BIG.TXT", TEXT * 4 + b"\x1a" * (-len(TEXT * 4) % 128)), ("HELLO.COM", NOISE[:1280])]
    pascal = V.write_pascal("DISK", FILES)
    assert V.filesystem_of(pascal) == "pascal" and contents(V.read_pascal(pascal)) == want
    rdos = V.write_rdos(FILES)
    assert V.filesystem_of(rdos) == "rdos" and contents(V.read_rdos(rdos)) == want
    gutenberg = V.write_gutenberg(FILES)
    assert V.filesystem_of(gutenberg) == "gutenberg" and contents(V.read_gutenberg(gutenberg)) == [(n, d + bytes(-len(d) % 250)) for n, d in want]
    assert V.filesystem_of(bytes(2048)) == "unknown" and V.filesystem_of(bytes(1024) + b"BD" + bytes(100)) == "hfs"


def test_many_and_large_files_fill_several_disks():
    many = [a_file(f"T{i}", b"turn %d " % i * (i + 1), b"") for i in range(40)]
    want = [(f["name"], f["data_fork"]) for f in many]
    assert [(f["name"], f["data_fork"].rstrip(b"\0")) for f in V.read_gutenberg(V.write_gutenberg(many))] == want
    large = rng.randbytes(299_999) + b"!"
    crowd = [a_file(f"F{i}", b"%d" % i, b"") for i in range(600)]
    for files in (many, [*many, a_file("LARGE", large, b""), *many[:3]], crowd, []):
        for disks, read, unit in ((V.gutenberg_disks(files), V.read_gutenberg, 250), (V.dos_disks(files), V.read_dos, 256), (V.dos_disks(files, 13), V.read_dos, 256)):
            got = []
            for f in (f for d in disks for f in read(d)):
                if got and got[-1][0] == f["name"]:
                    got[-1][1] += f["data_fork"]
                else:
                    got.append([f["name"], f["data_fork"]])
            assert got == [[f["name"], f["data_fork"] + bytes(-len(f["data_fork"]) % unit)] for f in files]
            assert len(disks) == 1 or len(files) > 40
    for write in (V.write_gutenberg, V.write_dos):
        with pytest.raises(W.ContainerError):
            write([a_file("LARGE", large, b"")])


def test_images_and_partitions():
    volume = V.write_pascal("DISK", FILES)
    assert D.image_format(D.write_disk_copy("Disk", volume, b"t" * 24)) == "diskcopy"
    info = D.disk_copy(D.write_disk_copy("Disk", volume, b"t" * 24))
    assert info["raw"] == volume and info["data_ok"] and info["tag_ok"] and info["name"] == "Disk"
    for sized in (True, False):
        assert D.raw_sectors(D.write_two_img(volume, sized=sized))[:2] == ("2img", volume)
    kind, raw, _ = D.raw_sectors(D.write_dart(volume))
    assert kind == "dart" and raw[: len(volume)] == volume
    mfs = V.write_mfs("M", FILES)
    apm = D.write_apm([("Driver", "Apple_Driver43", b"x"), ("M", "Apple_MFS", mfs), ("P", "Apple_ProDOS", bytes(4096))])
    assert D.image_format(apm) == "apm" and [p.name for p in D.partitions(apm)] == ["Driver", "M", "P"]
    best, part = D.best_partition(apm)
    assert best.type == "Apple_MFS" and contents(V.read_volume(part)) == contents(FILES)
    ts = D.write_mac_ts([(b"TFS1", bytes(2048)), (b"TFS1", mfs)])
    assert D.image_format(ts) == "mac_ts" and V.read_volume(D.best_partition(ts)[1])
    hd = D.write_hard_disk(b"Parsons Engin.", [("One", volume), ("Two", volume)])
    assert [(p.scheme, p.name) for p in D.partitions(hd)] == [("focusdrive", "One"), ("focusdrive", "Two")]
    assert D.image_format(bytes(84)) == "unknown" and D.image_format(bytes(2000)) == "raw"
    assert D.sector_order(bytes(143_360), "a.dsk") == "dos" and D.sector_order(b"", "a.po") == "prodos"


def test_resources():
    rows = [("STR ", 128, "greeting", b"\x05Hello"), ("STR ", -5, None, b"\x02yo"), ("ICN#", 1, None, b"\xff" * 256)]
    fork = R.build_fork(rows)
    found = R.parse_fork(fork)
    assert [(r.type_code, r.resource_id, r.name, R.resource_data(fork, r)) for r in found] == rows
    assert R.describe(found[0]) == "STR  #128 'greeting' (6 bytes)"
    assert "STR  (2)" in R.overview(found) and R.parse_fork(b"junk") == []
    assert R.best_icon(fork)[:2] == (32, 32) and R.png(R.best_icon(fork))[:4] == b"\x89PNG"
    assert R.render("icl8", bytes(10)) is None and R.render("xxxx", bytes(999)) is None
    assert R.render("icl4", bytes(512))[2][:4] == b"\xff\xff\xff\xff" and len(R.palette_256()) == 256
    menu = bytes(2) + b"\x80"[:0] + bytes(12) + b"\x04File" + b"\x04Open\0O\0\0" + b"\x01-\0\0\0\0" + b"\0"
    assert R.menu(menu) == {"menu_id": 0, "title": "File", "items": [{"title": "Open", "key": "O", "separator": False}, {"title": "-", "key": None, "separator": True}]}
    import struct

    snd = struct.pack(">HHHIHHHI", 1, 1, 5, 0, 1, 0x8051, 0, 20) + struct.pack(">IIIIIBB", 0, 4, 22050 << 16, 0, 0, 0, 60) + b"\x80\x90\xa0\x70"
    assert R.sound(snd)["rate"] == 22050 and R.sound_samples(snd) == b"\x80\x90\xa0\x70"
    assert R.envelope(b"\x10\x20\x30\x05", 2) == [(16, 32), (5, 48)]
    assert R.mac_paint(bytes(512) + C.pack_bits(b"\xff" * 51840))[:2] == (576, 720)


@pytest.mark.parametrize("data", [
    W.write_macbinary(a_file()), W.write_binhex(a_file()), W.write_apple_single(a_file()), W.write_binary_ii([("A", 6, 0, TEXT)]), W.write_apple_link([("L", 6, 1, TEXT, NOISE)]),
    V.write_mfs("M", FILES), V.write_pascal("P", FILES), V.write_cpm(FILES[:1]), V.write_dos(FILES), V.write_prodos("V", FILES), V.write_rdos(FILES), V.write_gutenberg(FILES),
    D.write_disk_copy("D", NOISE), D.write_two_img(NOISE), D.write_dart(NOISE), D.write_apm([("M", "Apple_MFS", V.write_mfs("M", FILES))]), R.build_fork([("STR ", 1, "n", b"\x01x")]),
])
def test_cut_short(data):
    """Nothing but ContainerError comes from damaged input."""
    for n in range(0, len(data), max(64, len(data) // 60)):
        cut = data[:n]
        for read in (W.unwrap, lambda d: D.raw_sectors(d), V.read_volume, D.partitions, R.parse_fork):
            try:
                read(cut)
            except W.ContainerError:
                pass


def test_two_volumes_on_a_disk():
    half = V.write_dos(FILES).ljust(409_600, b"\0")
    other = V.write_dos([a_file("FOUR", b"4" * 300, b"")]).ljust(409_600, b"\0")
    names = ["ONE", "TWO", "THREE", "FOUR"]
    assert [f["name"] for f in V.read_dual_dos(half + other)] == names
    woven = b"".join(half[i : i + 256] + other[i : i + 256] for i in range(0, len(half), 256))
    assert [f["name"] for f in V.read_dual_dos(woven, interleaved=True)] == names
    with pytest.raises(W.ContainerError):
        V.read_dual_dos(half)


def test_slices_of_65536_blocks():
    slices = V.write_pascal("A", FILES).ljust(65536 * 512, b"\0") + bytes(65536 * 512) + V.write_mfs("B", FILES)
    assert [(p.scheme, p.start_block, p.type) for p in D.partitions(slices)] == [("cffa", 0, "pascal"), ("cffa", 131072, "mfs")]


def test_font_metrics_and_bdf():
    import struct

    head = struct.pack(">13h", 0, 32, 33, 0, 0, 10, 2, 0, 0, 0, 0, 12, 0)
    f = R.font(head)
    assert (f["first"], f["last"], f["ascent"], f["descent"], f["height"]) == (32, 33, 10, 2, 12) and "Ascent: 10" in R.font_text(f)
    # Two glyphs of 3 and 5 pixels, two rows of one word each.
    strike = struct.pack(">13h", 0, 65, 66, 5, 0, 0, 8, 2, 0, 2, 0, 0, 1) + bytes([0b10111001, 0, 0b01010001, 0]) + struct.pack(">4H", 0, 3, 8, 8)
    lines = R.bdf(strike, "F").split("\n")
    assert lines[0] == "STARTFONT 2.1" and "CHARS 2" in lines
    glyphs = [lines[i + 1 : i + 3] for i, x in enumerate(lines) if x == "BITMAP"]
    assert glyphs == [["A0", "40"], ["C8", "88"]]


def test_identical_fork_headers_by_both_builders():
    one = C.apple_double(b"rsrc", "TEXT", "ttxt", 0x100)
    assert W.read_apple(one)["rsrc_fork"] == b"rsrc" and W.read_apple(one)["finder_flags"] == 0x100
    padded = C.apple_double(b"", "AB", None, always=True)
    assert W.read_apple(padded)["type_code"] == "AB  " and W.read_apple(padded)["creator_code"] == "    "
    assert W.read_apple(C.apple_double(b"x", None, None))["type_code"] is None


def test_rdos_pascal_and_cpm_files_fill_several_disks():
    many = [a_file(f"T{i}", bytes([65 + i % 26]) * (300 + 7 * i), b"") for i in range(400)] + [a_file("LARGE", NOISE[:70_000], b"")]
    for disks, size in ((V.rdos_disks, 143_360), (V.cpm_disks, 143_360), (lambda f: V.pascal_disks("DISK", f), 143_360)):
        back, made = {}, disks(many)
        for d in made:
            for f in V.read_volume(d):
                back[f["name"]] = back.get(f["name"], b"") + f["data_fork"]
        assert {len(d) for d in made} == {size} and len(made) > 3
        assert {n: b.rstrip(b"\x1a") for n, b in back.items()} == {f["name"]: f["data_fork"].rstrip(b"\x1a") for f in many}
    for write in (V.write_rdos, V.write_cpm, lambda f: V.write_pascal("DISK", f)):
        with pytest.raises(W.ContainerError):
            write(many)


def test_text_is_no_cpm_directory():
    """A text's last sector that starts with a line's end, where a CP/M directory would lie."""
    files = [a_file("A", bytes(256) * 16, b""), a_file("B", b"\nshort end", b"")]
    assert V.filesystem_of(V.write_rdos(files)) == "rdos"
    assert V.filesystem_of(V.write_pascal("DISK", [a_file("A", b"x" * 18 * 512, b""), a_file("B", b"\nshort end", b"")])) == "pascal"


def soon(seconds, f):
    """What f gives; it has to come in so much CPU time, a few times what it takes."""
    began = process_time()
    out = f()
    assert process_time() - began < seconds
    return out


def test_checksum_of_a_disk_that_is_mostly_empty():
    def plain(data):
        total = 0
        for i in range(0, len(data) - 1, 2):
            total = total + int.from_bytes(data[i : i + 2], "big") & 0xFFFFFFFF
            total = total >> 1 | (total & 1) << 31
        return total

    for data in (b"", b"a", TEXT, NOISE, bytes(77) + NOISE + bytes(1001) + TEXT + bytes(13), bytes(6)):
        assert C.rotating_checksum(data) == plain(data)
    disk = TEXT + bytes(8 << 20)
    assert soon(0.6, lambda: D.disk_copy(D.write_disk_copy("Talk", disk)))["data_ok"]


def test_binhex_of_whole_arrays():
    f = a_file(data=TEXT * 40, rsrc=NOISE)
    assert contents([soon(0.9, lambda: W.read_binhex(W.write_binhex(f)))]) == contents([f])


def test_icons_are_scaled_as_arrays():
    icon = R.one_bit(NOISE[:128], 32, 32, NOISE[128:256])
    wide = soon(0.4, lambda: [R.scaled(R.one_bit(NOISE[:128], 32, 32, NOISE[128:256])) for _ in range(100)])[0]
    pixel = lambda image, x, y: image[2][4 * (y * image[0] + x) :][:4]
    assert wide[:2] == (128, 128) and all(pixel(wide, x, y) == pixel(icon, x // 4, y // 4) for x in range(128) for y in range(128))


def test_codecs_go_by_bytes_not_bits():
    data = TEXT * 40
    assert soon(0.9, lambda: C.unsqueeze(squeeze(data))) == (data, None)
    assert soon(1.5, lambda: C.unrepeat(C.repeat(data * 10))) == data * 10
    assert [C.unrepeat(x) for x in (b"a\x90", b"\x90\x05a", b"a\x90\x90b", b"a\x90\x01b", b"\x90\0\x90\x03")] == [b"a", b"a", b"a" * 144 + b"b", b"ab", b"\x90\x90\x90"]
    for version in (1, 2):
        assert C.unlzw(lzw(data, version), len(data), version) == data
    assert C.unlzhuf(lzhuf(data[:40_000]), 40_000) == data[:40_000]


def test_empty_macbinary_by_its_checksum():
    f = a_file(data=b"", rsrc=b"")
    blank = {v: W.write_macbinary(f, v) for v in (1, 2, 3)}
    for version in (2, 3):
        for data in (blank[version], blank[version] + bytes(8192)):
            assert W.identify(data) == "macbinary" and W.macbinary_version(data) == version and W.unwrap(data) == [f]
    for data in (blank[1], blank[2][:124] + bytes(2) + blank[2][126:], blank[2][:2] + b"x" + blank[2][3:], blank[2][:127], blank[2] + bytes(8193)):
        assert W.identify(data) is None and W.macbinary_version(data) is None


def test_lzhuf_of_many_texts_is_that_of_each(monkeypatch):
    from reliquary.functions import lzhuf_lanes as L

    texts = [b"", b"a", b"ab", b"abcabcabcabc", b"\0" * 500, NOISE[:700], TEXT[:1500], "Größe, größer ".encode() * 40] + [bytes(rng.choices(b"etaoin shr", k=rng.randrange(400))) for _ in range(30)]
    damaged = [NOISE[i : i + i % 70] for i in range(40)]
    for few in (0, 3, 20, 100):
        monkeypatch.setattr(L, "FEW", few)
        packed = L.lzhuf(texts)
        assert packed == [lzhuf(t) for t in texts] and L.unlzhuf(packed, [len(t) for t in texts]) == texts
        assert L.lzhuf(texts[5:9], 4000) == [lzhuf(t, 4000) for t in texts[5:9]]
        for size in (0, 5, 300, 3000):
            assert L.unlzhuf(damaged, [size] * 40, 7) == [C.unlzhuf(d, size, 7) for d in damaged]
    assert L.lzhuf([]) == [] and L.unlzhuf([], []) == []
    assert [len(x) for x in L.batches([3, 5 << 20, 8 << 20, 20 << 20, 1] + [0] * 5000, lambda x: x)] == [2, 1, 1, 4096, 905]


def test_lanes_of_trees_are_halved_each():
    import numpy as np

    from reliquary.functions.lzhuf_lanes import Trees

    alone, trees = [C.AdaptiveTree() for _ in range(3)], Trees(3)
    for t, n in zip(alone, (32_400, 32_300, 100), strict=True):
        for symbol in rng.choices(range(20), k=n):
            t.add(symbol)
    for lane, t in enumerate(alone):
        trees.put(lane, t)
    for _ in range(300):
        symbols = rng.choices(range(314), k=3)
        trees.add(np.arange(3), np.array(symbols))
        for t, symbol in zip(alone, symbols, strict=True):
            t.add(symbol)
    assert [vars(trees.one(lane)) for lane in range(3)] == [vars(t) for t in alone] and alone[0].count[-1] < 20_000


def test_lzhuf_of_many_texts_goes_as_arrays():
    from reliquary.functions import lzhuf_lanes as L

    texts = [TEXT[i % 50 : i % 50 + 300] for i in range(2000)]  # alone they take about 3 s
    assert L.unlzhuf(soon(2, lambda: L.lzhuf(texts)), [len(t) for t in texts]) == texts
