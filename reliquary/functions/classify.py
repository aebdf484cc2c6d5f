"""Labels and predicates over a file's name, type and creator codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type codes, extensions and file names by what they mean.
TEXT_TYPES = ("TEXT", "ttro", "sEXT", "utxt", "clpt", "ttxt")
TEXT_EXTENSIONS = tuple(
    "txt text utxt r rez p pas pp inc c h cp cpp hpp cc hh mm a asm s make mak def exp map hc nfo diz asc ans 1st me now faq "
    "html htm shtml xhtml css js mjs json jsonl xml xsl xslt dtd xsd csv tsv php asp jsp cgi rss atom svg swift m playground "
    "py pyw rb pl pm lua tcl tk awk sed sh bash zsh csh ksh fish java kt scala groovy clj cljs rs go zig nim d ts tsx jsx vue svelte "
    "hs ml mli erl ex exs lisp el scm rkt f f90 for ftn cob cbl ada adb ads bas vb vbs sql proto graphql gql "
    "yaml yml toml ini cfg conf plist env properties reg editorconfig eslintrc prettierrc md markdown mkd mkdn mdown rst adoc asciidoc org "
    "tex latex bib sty cls pod man mdoc rtf md5 sha1 sha256 sha512 sfv sum sig diff patch cmake gradle sbt cabal gemspec podspec gyp "
    "srt sub ass ssa vtt log out err".split()
)
TEXT_NAMES = (
    "readme", "read me", "read_me", "license", "licence", "copying", "authors", "contributors", "credits", "changelog", "changes", "history", "news", "todo", "fixme", "bugs", "hacking",
    "install", "building", "makefile", "gnumakefile", "rakefile", "gemfile", "podfile", "cartfile", "dockerfile", "vagrantfile", "procfile", "cmakelists.txt",
)
PREVIEWED = tuple(
    "png jpg jpeg gif tiff tif bmp heic heif webp svg ico icns psd eps raw cr2 nef arw dng pdf doc docx xls xlsx ppt pptx pages numbers keynote rtf rtfd "
    "mp3 aiff aif wav m4a aac flac ogg wma mid midi mp4 mov m4v avi mkv wmv qt webm ttf otf woff woff2 dfont usdz obj stl".split()
)
KIND_BY_TYPE = {
    "TEXT": "Plain Text", "ttro": "Read-Only Text (SimpleText)", "PICT": "QuickDraw Picture", "APPL": "Application", "snd ": "Sound Resource", "PNTG": "MacPaint Image", "MOOV": "QuickTime Movie", "MooV": "QuickTime Movie",
    "FONT": "Bitmap Font", "NFNT": "Bitmap Font", "sfnt": "TrueType Font", "rsrc": "Resource File", "INIT": "System Extension", "cdev": "Control Panel", "DRVR": "Desk Accessory", "sEXT": "Styled Text", "utxt": "Unicode Text",
    "AIFF": "AIFF Audio", "JPEG": "JPEG Image", "GIFf": "GIF Image", "PNGf": "PNG Image", "TIFF": "TIFF Image", "PDF ": "PDF Document", "WDBN": "Microsoft Word Document", "XLS ": "Microsoft Excel Spreadsheet",
    "SIT!": "StuffIt Archive", "SITD": "StuffIt Deluxe Archive", "dImg": "DiskCopy Disk Image", "ZSYS": "System File", "FNDR": "Finder",
}
KIND_BY_EXTENSION = {
    "txt": "Plain Text", "text": "Plain Text", "rtf": "Rich Text Format", "html": "HTML Document", "htm": "HTML Document", "css": "CSS Stylesheet", "js": "JavaScript", "json": "JSON Data", "xml": "XML Document", "csv": "CSV Data",
    "md": "Markdown Document", "markdown": "Markdown Document", "pdf": "PDF Document", "doc": "Word Document", "docx": "Word Document (Modern)", "xls": "Excel Spreadsheet", "xlsx": "Excel Spreadsheet (Modern)",
    "ppt": "PowerPoint Presentation", "pptx": "PowerPoint (Modern)", "png": "PNG Image", "jpg": "JPEG Image", "jpeg": "JPEG Image", "gif": "GIF Image", "tif": "TIFF Image", "tiff": "TIFF Image", "bmp": "Bitmap Image",
    "psd": "Photoshop Document", "eps": "Encapsulated PostScript", "svg": "SVG Vector Image", "pict": "QuickDraw Picture", "pct": "QuickDraw Picture", "mov": "QuickTime Movie", "mp4": "MPEG-4 Video", "avi": "AVI Video",
    "mp3": "MP3 Audio", "aif": "AIFF Audio", "aiff": "AIFF Audio", "wav": "WAV Audio", "flac": "FLAC Audio", "mid": "MIDI Music", "midi": "MIDI Music", "sit": "StuffIt Archive", "sitx": "StuffIt X Archive", "cpt": "Compact Pro Archive",
    "zip": "ZIP Archive", "rar": "RAR Archive", "7z": "7-Zip Archive", "gz": "Gzip Compressed", "bz2": "Bzip2 Compressed", "xz": "XZ Compressed", "tar": "Tar Archive", "iso": "ISO 9660 Disc Image", "dmg": "macOS Disk Image",
    "img": "Disk Image (DiskCopy)", "image": "Disk Image (DiskCopy)", "dsk": "Raw Disk Image", "disk": "Raw Disk Image", "mar": "DART Disk Archive", "toast": "Toast Disc Image", "bin": "MacBinary / Binary", "hqx": "BinHex 4.0 Encoded",
    "sea": "Self-Extracting Archive", "rsrc": "Resource Fork Data", "c": "C Source Code", "h": "C Source Code", "cpp": "C++ Source Code", "hpp": "C++ Source Code", "cc": "C++ Source Code", "m": "Objective-C Source",
    "swift": "Swift Source Code", "p": "Pascal Source Code", "pas": "Pascal Source Code", "r": "Rez Source (Resources)", "rez": "Rez Source (Resources)", "py": "Python Script", "rb": "Ruby Script", "sh": "Shell Script",
    "java": "Java Source Code", "ttf": "TrueType Font", "otf": "OpenType Font", "dfont": "Data-Fork Font", "nfo": "NFO Info File", "md5": "MD5 Checksum", "log": "Log File", "plist": "Property List",
    "yaml": "YAML Configuration", "yml": "YAML Configuration", "ini": "Configuration File", "cfg": "Configuration File", "sql": "SQL Script", "dd": "DiskDoubler Archive",
}
ARCHIVE_SUFFIXES = (
    (".tar.gz", "compressed tar archive"), (".tgz", "compressed tar archive"), (".tar.bz2", "bzip2 tar archive"), (".tbz2", "bzip2 tar archive"), (".tar.xz", "XZ-compressed tar archive"), (".txz", "XZ-compressed tar archive"),
    (".mar.xz", "XZ-compressed Macintosh archive"),
)
ARCHIVES = {
    "sit": "StuffIt archive", "sitx": "StuffIt X archive", "sea": "self-extracting StuffIt archive", "cpt": "Compact Pro archive", "dd": "DiskDoubler archive", "pit": "PackIt archive", "7z": "7-Zip archive", "rar": "RAR archive",
    "zip": "ZIP archive", "gz": "Gzip-compressed file", "bz2": "Bzip2-compressed file", "xz": "XZ-compressed file", "lzma": "LZMA-compressed file", "zst": "Zstandard-compressed file", "tar": "tar archive", "cab": "Windows Cabinet archive",
    "arj": "ARJ archive", "arc": "ARC archive", "zoo": "Zoo archive", "lzh": "LHA/LZH archive", "lha": "LHA/LZH archive", "mar": "Macintosh archive", "iso": "ISO 9660 disc image", "dmg": "macOS disk image", "bin": "raw CD/DVD image",
    "cue": "CUE sheet (CD layout)", "nrg": "Nero disc image", "cdr": "macOS disc master image", "toast": "Toast disc image", "img": "HFS disk image", "image": "HFS disk image", "dart": "DART disk archive", "dsk": "HFS disk image",
    "disk": "HFS disk image", "hfs": "HFS volume", "hfv": "HFS volume",
}
UNPACKED = tuple("sit sitx sea cpt dd hqx bin pit now arc zoo lzh lha arj zip rar 7z cab tar gz tgz bz2 tbz tbz2 xz txz lzma tlz zst z iso cue nrg cdr toast msi nsis deb rpm dmg adf dms lzx".split())
DISK_IMAGES = tuple("img image dsk disk hfs hfv dart 2mg 2img po do iso toast cdr".split())
MOUNTED = ("iso", "toast", "cdr", "dmg")
SMALL_CONTAINERS = ("bny", "bqy", "acu")
FONT_TYPES, FONT_EXTENSIONS = ("FFIL", "sfnt", "FONT", "NFNT", "LWFN", "tfil", "OTTO"), ("ttf", "otf", "dfont", "suit", "pfb", "afm", "bdf")
LEGACY_TYPES = tuple(
    "nX^n nX^d nX^r MWPd MWPr MW2D MACA WORD WDBN W6BN W8BN WDMC AWWP AWDB AWSS AWDR CWWP CWSS CWDB CWGR CWPR CWPT BOBO NISI GLOB NSCT NIS! FWRT FWRP WPC2 WPD2 WPD3 RTd1 RTSt BWwp BWdb BWss RSGD MMPP MORE MOR2 SWCw "
    "ZWRT MaxW MWII EDOC HANM LWT1 LWT2 LWTR DOCM MARI MWRT MIWR MOUS".split()
)
LEGACY_EXTENSIONS = ("nx", "nxn", "nxd", "mcw", "mw", "mw2", "mwd", "mwii", "cwk", "cws")


def extension(name: Column) -> Column:
    """What follows the last dot, lower case; '' for names that only start with one."""
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))


def _look(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def type_creator(type_code: Column, creator: Column) -> Column:
    """type/creator, type alone, or null."""
    return F.when(type_code.isNull(), F.lit(None).cast("string")).otherwise(F.concat_ws("/", type_code, creator))


def _any(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def is_text(name: Column, type_code: Column) -> Column:
    return _any(type_code.isin(*TEXT_TYPES), extension(name).isin(*TEXT_EXTENSIONS), F.lower(name).isin(*TEXT_NAMES))


def is_previewed(name: Column, type_code: Column) -> Column:
    return _any(extension(name).isin(*PREVIEWED), is_text(name, type_code))


def kind_label(name: Column, type_code: Column) -> Column:
    return F.coalesce(_look(type_code, KIND_BY_TYPE), _look(extension(name), KIND_BY_EXTENSION))


def archive_label(name: Column) -> Column:
    out = F.coalesce(_look(extension(name), ARCHIVES), F.lit("compressed archive"))
    for suffix, label in reversed(ARCHIVE_SUFFIXES):
        out = F.when(F.lower(name).endswith(suffix), F.lit(label)).otherwise(out)
    return out


def is_archive(name: Column) -> Column:
    return _any(extension(name).isin(*UNPACKED), F.lower(name).rlike(r"\.tar\.(gz|bz2|xz|lzma|zst|z)$"))


def is_disk_image(name: Column) -> Column:
    return _any(extension(name).isin(*DISK_IMAGES))


def is_mounted(name: Column) -> Column:
    return _any(extension(name).isin(*MOUNTED))


def is_extractable(name: Column) -> Column:
    return _any(is_archive(name), is_disk_image(name), extension(name).isin(*SMALL_CONTAINERS))


def is_font(name: Column, type_code: Column) -> Column:
    return _any(type_code.isin(*FONT_TYPES), extension(name).isin(*FONT_EXTENSIONS))


def is_pict(name: Column, type_code: Column) -> Column:
    return _any(type_code == "PICT", extension(name).isin("pict", "pct"))


def is_mac_paint(name: Column, type_code: Column) -> Column:
    return _any(type_code == "PNTG", extension(name).isin("pntg", "mac"))


def is_legacy_document(name: Column, type_code: Column, head: Column | None = None) -> Column:
    """By type code, extension, or the first bytes of the data fork."""
    magic = [F.substring(head, 1, 8) == F.lit(b"WriteNow")] if head is not None else []
    return _any(type_code.isin(*LEGACY_TYPES), extension(name).isin(*LEGACY_EXTENSIONS), *magic)


def is_claris_works(type_code: Column, creator: Column) -> Column:
    return _any(type_code.isin("CWWP", "CWSS", "CWDB", "CWGR", "CWPR", "CWK "), creator == "BOBO")


def is_mac_write(type_code: Column, head: Column) -> Column:
    return _any(type_code.isin("WORD", "MWPd", "MW2D"), F.substring(head, 1, 2).isin(F.lit(b"\0\3"), F.lit(b"\0\6")))


def convert_target(name: Column, type_code: Column, creator: Column) -> Column:
    """What a file can be converted to, or null."""
    return (
        F.when(is_mac_paint(name, type_code), F.lit("PNG"))
        .when(_any(type_code == "snd "), F.lit("WAV"))
        .when(is_claris_works(type_code, creator) | is_legacy_document(name, type_code), F.lit("Markdown"))
        .when(is_text(name, type_code), F.lit("UTF-8 text"))
    )


def preview_kind(name: Column, type_code: Column, data_size: Column, has_icon: Column, rsrc_size: Column) -> Column:
    """The first preview that applies; text ends the search even if it can't be read."""
    return (
        F.when(is_font(name, type_code), F.lit("font"))
        .when(is_legacy_document(name, type_code), F.lit("document"))
        .when(is_text(name, type_code), F.lit("text"))
        .when(is_mac_paint(name, type_code), F.lit("macpaint"))
        .when(is_pict(name, type_code), F.lit("pict"))
        .when(has_icon, F.lit("icon"))
        .when(rsrc_size > 0, F.lit("resources"))
        .when(data_size > 0, F.lit("hex"))
        .otherwise(F.lit("none"))
    )


def flags_text(flags: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(flags.cast("long")), 4, "0"))
