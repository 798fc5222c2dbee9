"""Content rules: a catalogue as data, and its evaluation over columns of texts.

A rule fires where one of its ``any_of`` literals, all of its ``all_of``
literals and its regular expression are found in the lower-cased text. With
``near`` literals the expression must match within 1024 characters of one of
them, wherever that stands, which bounds what it may span. ``findings`` evaluates a whole catalogue
in one pass of Arrow batches, text by text: Aho-Corasick finds all literals, and
a regular expression is tried only where its literals are, and in windows for texts
over 1024 characters. A worker holds a batch as it came and one text beside it, and
gives back the places of the rules that fire.

The patterns are in RE2 syntax and meaning; ``java`` and ``python`` say the same
to the other engines, for which word boundaries and white space mean more.
"""

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


class Rule(NamedTuple):
    name: str
    score: int
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    regex: str = ""
    near: tuple[str, ...] = ()
    #: Literals of which every match of the expression holds one; they spare texts without any a search.
    hint: tuple[str, ...] = ()


#: Characters on either side of an anchor that are looked at; beginnings of windows this far apart are searched at once.
REACH, TOGETHER = 1024, 4096

# Rule names, scores, literals and patterns.
SCRIPT = (
    Rule('Heuristic.PowerShell.EncodedCommand', 60, any_of=('powershell', 'pwsh'), regex=r'''\s-(e|en|enc|enco|encod|encode|encoded|encodedc|encodedcommand|ec)\s+["']?[a-z0-9+/=]{40,}'''),
    Rule('Heuristic.PowerShell.HiddenWindow', 25, any_of=('powershell', 'pwsh'), regex=r"-w(indowstyle|in|i)?\s+(hidden|1)\b"),
    Rule('Heuristic.PowerShell.ExecutionPolicyBypass', 15, regex=r"-(ep|exec|executionpolicy)\s+(bypass|unrestricted)", near=('bypass', 'unrestricted')),
    Rule('Heuristic.PowerShell.DownloadCradle', 30, any_of=('downloadstring(', 'downloadfile(', 'downloaddata(', 'invoke-webrequest', 'start-bitstransfer', 'net.webclient', 'iwr ', 'invoke-restmethod')),
    Rule('Heuristic.PowerShell.DynamicExecution', 30, regex=r"(invoke-expression|\biex\s*\(\s*(new-object|\[|\(|\$)|\|\s*iex\b)", near=('invoke-expression', 'iex')),
    Rule('Heuristic.PowerShell.Base64Decode', 15, any_of=('frombase64string',)),
    Rule('Heuristic.PowerShell.ReflectiveLoad', 35, any_of=('reflection.assembly]::load(', '[reflection.assembly]::load', 'assembly]::load(')),
    Rule('Heuristic.PowerShell.ShellcodeLoader', 60, any_of=('virtualalloc',), all_of=('getdelegateforfunctionpointer',)),
    Rule('Heuristic.PowerShell.AMSIBypass', 100, any_of=('amsiinitfailed', 'amsiscanbuffer', 'amsiutils', 'amsicontext')),
    Rule('Heuristic.PowerShell.DefenderTamper', 60, any_of=('set-mppreference -disablerealtimemonitoring $true', 'disablerealtimemonitoring 1', 'add-mppreference -exclusionpath')),
    Rule('Heuristic.Script.WScriptShell', 30, any_of=('wscript.shell',)),
    Rule('Heuristic.Script.ShellApplication', 25, any_of=('shell.application',), all_of=('shellexecute',)),
    Rule('Heuristic.Script.ActiveX', 10, any_of=('activexobject', 'createobject(')),
    Rule('Heuristic.Script.HTTPDownload', 25, any_of=('msxml2.xmlhttp', 'microsoft.xmlhttp', 'winhttp.winhttprequest', 'msxml2.serverxmlhttp')),
    Rule('Heuristic.Script.WriteBinary', 30, any_of=('adodb.stream',), all_of=('savetofile',)),
    Rule('Heuristic.Script.DropExecutable', 40, regex=r"savetofile\s*\(?[^\n]{0,200}\.(exe|dll|scr|com|pif|bat|cmd|ps1|vbs|js|hta)\b", near=('savetofile',)),
    Rule('Heuristic.Script.Obfuscation', 20, regex=r"eval\s*\(\s*(unescape|atob|string\.fromcharcode|decodeuricomponent|function\s*\(p,\s*a,\s*c,\s*k,\s*e)", near=('eval',)),
    Rule('Heuristic.Script.CharCodeObfuscation', 20, regex=r"((chrw?|string\.fromcharcode)\s*\(\s*\d+\s*\)[^\n]{0,20}){25,}", near=('fromcharcode', 'chr')),
    Rule('Heuristic.Script.LOLBin.Mshta', 30, regex=r'''mshta(\.exe)?\s+["']?(https?:|vbscript:|javascript:)''', near=('mshta',)),
    Rule('Heuristic.Script.LOLBin.Regsvr32', 60, regex=r"regsvr32(\.exe)?[^\n]*/i:\s*https?:", near=('regsvr32',)),
    Rule('Heuristic.Script.LOLBin.Certutil', 50, regex=r"certutil(\.exe)?[^\n]*-(urlcache|decode|decodehex)", near=('certutil',)),
    Rule('Heuristic.Script.LOLBin.Bitsadmin', 40, regex=r"bitsadmin(\.exe)?[^\n]*/transfer", near=('bitsadmin',)),
    Rule('Heuristic.Script.LOLBin.Rundll32', 30, regex=r"rundll32(\.exe)?[^\n]*(javascript:|mshtml,runhtmlapplication|\\\\\\\\[a-z0-9.]+\\|https?:)", near=('rundll32',)),
    Rule('Heuristic.Script.SpawnsPowerShell', 20, any_of=('powershell.exe', 'powershell -', 'powershell.exe -', 'pwsh -')),
    Rule('Heuristic.Script.Persistence.RunKey', 25, regex=r"(reg(\.exe)?\s+add|regwrite|set-itemproperty|new-itemproperty)[^\n]*currentversion\\+run", near=('currentversion\\',)),
    Rule('Heuristic.Script.Persistence.ScheduledTask', 20, any_of=('schtasks /create', 'schtasks.exe /create', 'register-scheduledtask')),
    Rule('Heuristic.Script.Ransomware.ShadowCopyDeletion', 70, regex=r"(vssadmin(\.exe)?\s+delete\s+shadows|wmic(\.exe)?\s+shadowcopy\s+delete|get-wmiobject\s+win32_shadowcopy[^\n]*delete)", near=('vssadmin', 'shadowcopy')),
    Rule('Heuristic.Script.Ransomware.RecoveryDisable', 50, regex=r"(wbadmin(\.exe)?\s+delete\s+(catalog|systemstatebackup)|bcdedit(\.exe)?\s+/set\s+\{default\}\s+(recoveryenabled\s+no|bootstatuspolicy\s+ignoreallfailures))", near=('wbadmin', 'bcdedit')),
    Rule('Heuristic.Script.AntiForensics.EventLogClear', 40, regex=r"(wevtutil(\.exe)?\s+cl\b|clear-eventlog)", near=('wevtutil', 'clear-eventlog')),
    Rule('Heuristic.Script.AddUser', 25, regex=r"net(\.exe)?\s+user\s+\S+\s+\S+\s+/add", near=('/add',)),
    Rule('Heuristic.Shell.PipeToShell', 40, regex=r"(curl|wget)[^\n|;]*\|\s*(sudo\s+)?(ba|da|z|k)?sh\b", near=('curl', 'wget')),
    Rule('Heuristic.Shell.Base64ToShell', 50, regex=r"base64\s+(-d|--decode)[^\n]*\|\s*(ba|da|z)?sh\b", near=('base64',)),
    Rule('Heuristic.Shell.ReverseShell', 100, regex=r"(/dev/tcp/\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}/\d+|\bnc(at)?\b[^\n]*\s-e\s*/bin/(ba)?sh|socat[^\n]*exec:[^\n]*(ba)?sh[^\n]*tcp|mkfifo[^\n]*\|\s*/bin/(ba)?sh[^\n]*\|\s*nc\b)", near=('/dev/tcp/', '/bin/sh', '/bin/bash', 'socat')),
    Rule('Heuristic.Shell.TmpExec', 25, regex=r"chmod\s+(\+x|[0-7]*7[0-7]{2})\s+/(tmp|var/tmp|dev/shm)/", near=('chmod',)),
    Rule('Heuristic.Shell.CronPersistence', 25, regex=r"(crontab|/etc/cron)[^\n]*(curl|wget)\s[^\n]*https?://|(curl|wget)\s[^\n]*https?://[^\n]*(crontab|/etc/cron)", near=('crontab', '/etc/cron')),
    Rule('Heuristic.Shell.SSHKeyPersistence', 30, regex=r">>\s*[^\n]*\.ssh/authorized_keys", near=('authorized_keys',)),
    Rule('Heuristic.Shell.LdPreload', 50, regex=r">\s*/etc/ld\.so\.preload", near=('ld.so.preload',)),
    Rule('Heuristic.Shell.LogWipe', 25, regex=r"(rm\s+-rf?\s+/var/log|history\s+-c|unset\s+histfile|>\s*/var/log/(wtmp|btmp|lastlog|auth\.log))", near=('/var/log', 'history', 'histfile')),
    Rule('Heuristic.Shell.SecurityDisable', 25, regex=r"(setenforce\s+0|systemctl\s+(stop|disable)\s+(apparmor|firewalld|auditd)|ufw\s+disable|iptables\s+-f\b)", near=('setenforce', 'systemctl', 'ufw', 'iptables')),
    Rule('Heuristic.Shell.CompetitorKill', 60, any_of=('kinsing', 'kdevtmpfsi', 'pkill -f xmrig', 'killall xmrig', 'pkill -9 xmr')),
    Rule('Heuristic.Miner.Stratum', 60, any_of=('stratum+tcp://', 'stratum+ssl://', 'stratum2+tcp://')),
    Rule('Heuristic.Miner.XMRig', 40, any_of=('xmrig',)),
    Rule('Heuristic.Python.ExecEncoded', 60, regex=r'''exec\s*\(\s*(__import__\(\s*['"](base64|zlib|marshal)['"]\s*\)|base64\.b64decode|zlib\.decompress|marshal\.loads)''', near=('exec',)),
    Rule('Heuristic.Python.ReverseShell', 100, all_of=('socket', 'subprocess'), regex=r'''(os\.dup2\s*\(\s*\w+\.fileno\(\)\s*,\s*[012]\s*\)|pty\.spawn\s*\(\s*["']/bin/(ba)?sh)''', near=('dup2', 'pty.spawn')),
    Rule('Heuristic.PHP.EvalEncoded', 60, regex=r"(eval|assert)\s*\(\s*(gzinflate|gzuncompress|str_rot13|base64_decode|gzdecode)\s*\(", near=('eval', 'assert')),
    Rule('Heuristic.PHP.WebShell', 100, regex=r'''(eval|assert|system|exec|passthru|shell_exec|popen|proc_open|pcntl_exec|create_function|preg_replace\s*\(\s*['"][^'"]*/e['"])\s*\(\s*(@?\$_(get|post|request|cookie|server)|base64_decode\s*\(\s*\$_)''', near=('$_', 'base64_decode')),
    Rule('Heuristic.PHP.KnownWebShell', 100, any_of=('c99shell', 'r57shell', 'wso shell', 'b374k', 'filesman', 'weevely'), regex=r"<\?php|<\?="),
    Rule('Heuristic.Tool.Mimikatz', 100, any_of=('sekurlsa::logonpasswords', 'lsadump::sam', 'lsadump::dcsync', 'invoke-mimikatz', 'sekurlsa::pth')),
)

BINARY = (
    Rule('Heuristic.Binary.Mimikatz', 100, any_of=('sekurlsa::logonpasswords', 'gentilkiwi', 'mimikatz'), all_of=('sekurlsa',)),
    Rule('Heuristic.Binary.Ransomware.ShadowDelete', 60, regex=r"(vssadmin(\.exe)?\s+delete\s+shadows|shadowcopy\s+delete|wbadmin\s+delete\s+catalog|recoveryenabled\s+no)", near=('vssadmin', 'shadowcopy', 'wbadmin', 'recoveryenabled')),
    Rule('Heuristic.Binary.Ransomware.Note', 40, regex=r"(your (files|documents|data)( and \w+)? (have been|are|were) (encrypted|locked)|decrypt(ion)? (tool|key|software)[^\n]{0,60}(bitcoin|btc|monero|tor browser))", near=('encrypted', 'locked', 'decrypt')),
    Rule('Heuristic.Binary.Miner.Stratum', 60, any_of=('stratum+tcp://', 'stratum+ssl://')),
    Rule('Heuristic.Binary.Miner.XMRig', 40, any_of=('xmrig',), all_of=('randomx',)),
    Rule('Heuristic.Binary.Meterpreter', 100, any_of=('metsrv.dll', 'metsrv.x64.dll', 'ext_server_stdapi')),
    Rule('Heuristic.Binary.CobaltStrike', 100, any_of=('beacon.dll', 'beacon.x64.dll', '%s as %s\\%s: %d', 'could not spawn %s: %d'), all_of=('reflectiveloader',)),
    Rule('Heuristic.Binary.ReflectiveLoader', 30, any_of=('reflectiveloader',)),
    Rule('Heuristic.Binary.IoTBot', 60, any_of=('/bin/busybox',), regex=r"(/dev/watchdog|/dev/misc/watchdog)[\s\S]*(tftp|wget|/proc/net/tcp)|(gafgyt|bashlite|lolnogtfo|killer_kill|attack_udp|attack_tcp_syn|udpplain|hilix)"),
    Rule('Heuristic.Binary.Rootkit.LdPreload', 40, any_of=('/etc/ld.so.preload',), all_of=('readdir',)),
    Rule('Heuristic.Binary.CryptojackerDropper', 60, any_of=('kinsing', 'kdevtmpfsi', 'watchbog', 'teamtnt')),
    Rule('Heuristic.Binary.AMSIBypass', 40, any_of=('amsiscanbuffer',), all_of=('virtualprotect',)),
    Rule('Heuristic.Binary.ReverseShell', 50, all_of=('connect',), regex=r"(/bin/sh -i|/bin/bash -i|cmd\.exe /k)", near=('/bin/sh -i', '/bin/bash -i', 'cmd.exe /k')),
)

VBA = (
    Rule('Heuristic.Macro.AutoExec', 30, regex=r"\b(autoopen|auto_open|autoexec|autoclose|auto_close|document_open|documentopen|document_close|workbook_open|workbook_activate|workbook_beforeclose|app_documentopen|app_workbookopen|document_new|autonew)\b", hint=('autoopen', 'auto_open', 'autoexec', 'autoclose', 'auto_close', 'document_open', 'documentopen', 'document_close', 'workbook_open', 'workbook_activate', 'workbook_beforeclose', 'app_workbookopen', 'document_new', 'autonew')),
    Rule('Heuristic.Macro.Shell', 35, regex=r'(\bshell\s*\(|\bshell\s+["\w]|wscript\.shell|shellexecute|\.run\s*\(?["\w]|\.exec\s*\(|win32_process|\.create\s*\()', hint=('shell', '.run', '.exec', 'win32_process', '.create')),
    Rule('Heuristic.Macro.Download', 35, any_of=('urldownloadtofile', 'msxml2.xmlhttp', 'microsoft.xmlhttp', 'winhttp.winhttprequest', 'msxml2.serverxmlhttp', 'internetexplorer.application', 'downloadfile', 'downloadstring')),
    Rule('Heuristic.Macro.WriteFile', 20, any_of=('adodb.stream', 'savetofile', 'put #', 'binary access write', 'scripting.filesystemobject')),
    Rule('Heuristic.Macro.PowerShell', 40, any_of=('powershell', 'pwsh', 'mshta', 'cscript', 'wscript.exe', 'cmd.exe', 'cmd /c', 'regsvr32', 'rundll32', 'certutil')),
    Rule('Heuristic.Macro.Win32API', 30, regex=r'declare\s+(ptrsafe\s+)?(function|sub)\s+\w+\s+lib\s+"(kernel32|ntdll|user32|shell32|urlmon)', hint=('declare',)),
    Rule('Heuristic.Macro.ShellcodeInjection', 70, any_of=('virtualalloc', 'virtualallocex', 'rtlmovememory', 'createthread', 'writeprocessmemory', 'enumsystemlocales', 'createtimerqueuetimer'), all_of=('lib "kernel32',)),
    Rule('Heuristic.Macro.Obfuscation', 20, regex=r"((chrw?\$?\s*\(\s*[\d&h]+\s*[\-+*/xor ]*\s*[\d&h]*\s*\)\s*[&+]\s*){15,}|strreverse\s*\(|callbyname\s*\()", hint=('chr', 'strreverse', 'callbyname')),
    Rule('Heuristic.Macro.Environment', 10, any_of=('environ(', 'environ$(', '%temp%', '%appdata%', 'getspecialfolder')),
    Rule('Heuristic.Macro.AntiAnalysis', 20, any_of=('application.displayalerts = false', 'accessvbom', 'vbawarnings', 'application.screenupdating = false'), all_of=('reg',)),
)

PDF_JS = (
    Rule('Heuristic.PDF.JS.HeapSpray', 60, regex=r'''(%u0c0c%u0c0c|%u9090%u9090|%u0a0a%u0a0a|\\x0c\\x0c\\x0c\\x0c|unescape\s*\(\s*["']%u[0-9a-f]{4}%u)''', hint=('%u', r'\x0c\x0c\x0c\x0c')),
    Rule('Heuristic.PDF.JS.KnownExploit', 80, any_of=('util.printf', 'collab.geticon', 'collab.collectemailinfo', 'spell.customdictionaryopen', 'media.newplayer', 'getannots', 'doc.printseps')),
    Rule('Heuristic.PDF.JS.Eval', 20, regex=r"eval\s*\(|unescape\s*\(|string\.fromcharcode", hint=('eval', 'unescape', 'string.fromcharcode')),
    Rule('Heuristic.PDF.JS.Export', 30, any_of=('exportdataobject', 'app.launchurl', 'this.submitform')),
)

CATALOGUES = {"script": SCRIPT, "binary": BINARY, "vba": VBA, "pdf_js": PDF_JS}

FINDING = "struct<name:string,score:int>"

_BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_TOKEN = re.compile(r"\\.|\[\^?\]?|\]|\$|.", re.S)


def _translate(pattern: str, end: str, begin: str = "^", boundary: str = _BOUNDARY) -> str:
    out, inside = [], False
    for token in _TOKEN.findall(pattern):
        if token == r"\b":
            token = boundary
        elif token == r"\s":
            token = r" \t\n\f\r" if inside else r"[ \t\n\f\r]"
        elif token == r"\S":
            token = r"\x00-\x08\x0b\x0e-\x1f\x21-\x{10ffff}" if inside else r"[^ \t\n\f\r]"
        elif token == "$" and not inside:
            token = end
        elif token == "^" and not inside:
            token = begin
        elif token[0] == "[":
            inside = True
        elif token == "]":
            inside = False
        out.append(token)
    return "".join(out).replace(r"[ \t\n\f\r\x00-\x08\x0b\x0e-\x1f\x21-\x{10ffff}]", r"(?s:.)")


def java(pattern: str) -> str:
    """The RE2 pattern for Java's engine."""
    return _translate(pattern, r"\z")


@functools.cache
def python(pattern: str) -> re.Pattern[str]:
    """The RE2 pattern for Python's engine."""
    return re.compile(_translate(pattern, r"\Z"), re.ASCII)


@functools.cache
def unbound(pattern: str) -> re.Pattern[str]:
    """The RE2 pattern without what looks beyond a match: it matches wherever a part of the text, taken by itself, has a match."""
    return re.compile(_translate(pattern, "", "", ""), re.ASCII)


@functools.cache
def literals_of(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    return tuple(sorted({x for r in rules for x in (*r.any_of, *r.all_of, *r.near, *r.hint)}))


@functools.cache
def _automaton(literals: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for place, literal in enumerate(literals):
        found.add_word(literal, place)
    found.make_automaton()
    return found


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(text: str) -> str:
    """A to Z lower-cased and no other character."""
    try:
        return text.encode("latin-1").lower().decode("latin-1")
    except UnicodeEncodeError:
        return text.translate(_LOWER)


def windows(text: str, rule: Rule) -> Iterator[list[tuple[int, int]]]:
    """Where the windows around all anchors begin and end, one anchor after another, in runs that begin near each other."""
    for anchor in rule.near:
        run: list[tuple[int, int]] = []
        at = text.find(anchor)
        while at >= 0:
            begin = max(0, at - REACH)
            if run and begin - run[0][0] > TOGETHER:
                yield run
                run = []
            run.append((begin, at + len(anchor) + REACH))
            at = text.find(anchor, at + len(anchor))
        if run:
            yield run


def near_matches(text: str, rule: Rule) -> bool:
    """Whether a window has a match by itself. Windows overlap: those of a part that has no match even unbound are not searched one by one."""
    exact, loose = python(rule.regex), unbound(rule.regex)

    def among(run: list[tuple[int, int]]) -> bool:
        if len(run) == 1:
            return bool(exact.search(text[slice(*run[0])]))
        half = len(run) // 2
        return bool(loose.search(text, run[0][0], run[-1][1])) and (among(run[:half]) or among(run[half:]))

    return any(map(among, windows(text, rule)))


def fired(text: str, rules: tuple[Rule, ...]) -> list[int]:
    """Places in the catalogue, ascending, of the rules that fire in the text, upper case read as lower."""
    low, literals = lowered(text), literals_of(rules)
    held = {literals[place] for place in {place for _, place in _automaton(literals).iter(low)}}
    return [i for i, rule in enumerate(rules) if _fires(low, held, rule)]


def _fires(low: str, held: set[str], rule: Rule) -> bool:
    if not held.issuperset(rule.all_of) or any(some and held.isdisjoint(some) for some in (rule.any_of, rule.near, rule.hint)):
        return False
    if not rule.regex:
        return True
    return near_matches(low, rule) if rule.near and len(low) > REACH else bool(python(rule.regex).search(low))


def places(text: Column, rules: tuple[Rule, ...]) -> Column:
    """array<int>: what ``fired`` gives for each text, none for a null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(([] if (t := x.as_py()) is None else fired(t, rules) for x in texts), pa.list_(pa.int32()))

    return F.arrow_udf(run, ArrayType(IntegerType()))(text)


def finding(name: str, score: int) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(score).cast("int").alias("score"))


def chosen(*tests: tuple[Column, str, int]) -> Column:
    """array<FINDING> of the tests that hold, in order; a null test doesn't."""
    return F.filter(F.array(*(F.when(test, finding(name, score)) for test, name, score in tests)), lambda f: f.isNotNull())


def findings(rows: DataFrame, text: str, rules: tuple[Rule, ...], out: str) -> DataFrame:
    """The rows with ``out``, array<FINDING>, of the rules that fire in column ``text``, upper case read as lower."""
    held = f"__{out}_places"
    known = F.array(*(finding(r.name, r.score) for r in rules))
    return rows.withColumn(held, places(F.col(text), rules)).withColumn(out, F.transform(held, lambda i: F.get(known, i))).drop(held)


def mentions(text: Column, literal: str) -> Column:
    """Whether the text holds a lower-case literal, upper case read as lower."""
    return text.rlike("(?i)" + re.escape(literal))


def distinct_findings(found: Column) -> Column:
    """The first finding of every name whose score is over zero."""
    kept = F.filter(found, lambda f: f["score"] > 0)
    names = F.transform(kept, lambda f: f["name"])
    return F.filter(kept, lambda f, i: F.array_position(names, f["name"]) == i + 1)


def exploded(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row for each finding: the kept columns, seq (its place), name, score.

    The outer form of explode is meant: the other one makes Spark filter by the
    array's size first, which would compute all rules twice.
    """
    each = rows.select(*keep, F.posexplode_outer(column).alias("seq", "f")).where("f is not null")
    return each.select(*keep, "seq", F.col("f.name").alias("name"), F.col("f.score").alias("score"))
