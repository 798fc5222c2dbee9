import os
import socketserver
import threading
from pathlib import Path

import pytest

from verdikt.config import config_path, data_folder
from verdikt.operators import clamd


class Daemon(socketserver.StreamRequestHandler):
    replies = {b"zPING\0": b"PONG\0", b"zVERSION\0": b"ClamAV 1.4.1/27000/Mon\0"}

    def handle(self):
        command = b""
        while not command.endswith(b"\0"):
            command += self.rfile.read(1)
        self.wfile.write(Daemon.replies.get(command, b"UNKNOWN COMMAND\0"))


def test_daemon_status(tmp_path, monkeypatch):
    address = str(tmp_path / "clamd")
    with socketserver.ThreadingUnixStreamServer(address, Daemon) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        clamd.ping(address)
        assert clamd.version(address) == "ClamAV 1.4.1/27000/Mon" and clamd.described("auto", address) == f"{address}, ClamAV 1.4.1/27000/Mon"
        monkeypatch.setitem(Daemon.replies, b"zVERSION\0", b"COMMAND UNAVAILABLE\0")
        assert clamd.described("required", address) == f"{address}, version unknown"
        with pytest.raises(ValueError, match="COMMAND UNAVAILABLE"):
            clamd.version(address)
        monkeypatch.setitem(Daemon.replies, b"zPING\0", b"?\0")
        with pytest.raises(ValueError, match="PING"):
            clamd.ping(address)
        server.shutdown()
    assert clamd.described("off", address) == "disabled" and "cannot be reached" in clamd.described("auto", str(tmp_path / "gone")) and "no address" in clamd.described("auto", "")


def test_which_settings(tmp_path, monkeypatch):
    system, user = (tmp_path / "etc", tmp_path / "var"), tmp_path / "home/verdikt/config.json"
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "share"))
    monkeypatch.delenv("VERDIKT_CONFIG", raising=False)
    shared = system[0] / "config.json"
    ask = lambda explicit=None, root=False: config_path(explicit, system, root)
    assert ask("x.json") == Path("x.json") and ask() == user and ask(root=True) == shared
    os.makedirs(system[1])
    assert ask() == shared  # no file of the user's own: the table that root keeps
    user.parent.mkdir(parents=True)
    user.write_text("{}")
    assert ask() == user
    os.makedirs(system[0])
    shared.write_text("{}")
    assert ask() == shared
    monkeypatch.setenv("VERDIKT_CONFIG", "env.json")
    assert ask() == Path("env.json") and ask("x.json") == Path("x.json")
    assert data_folder(shared, system, False) == system[1] == data_folder(user, system, True) and data_folder(user, system, False) == tmp_path / "share/verdikt"
