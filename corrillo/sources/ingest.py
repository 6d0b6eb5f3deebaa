"""Taking in an exported archive: extraction, copy, and a description of the source. Files of one chat, on the driver."""

from __future__ import annotations

import hashlib
import logging
import os
import re
import shutil
import time
import unicodedata
import zipfile
from pathlib import Path

from corrillo.sources.config import Existing, active_chat, valid_chat

log = logging.getLogger("corrillo")
ARCHIVE = re.compile(r"(?:WhatsApp Chat - |WhatsApp Chat with |Chat de WhatsApp con )(.+)\.zip")


def group_name(archive: Path) -> str:
    """The group in the archive's name; the name itself where it has another form."""
    found = ARCHIVE.fullmatch(archive.name)
    return found[1] if found else archive.stem


def slug_of(group: str) -> str:
    """The folder of a group: its name in lower-case ASCII letters and digits, with _ between."""
    plain = unicodedata.normalize("NFKD", group).encode("ascii", "ignore").decode().lower()
    words = re.findall("[a-z0-9]+", plain)
    if not words:
        raise ValueError(f"no folder name can be made of {group!r}: pass the chat")
    return "_".join(words)


def chosen_export(params: dict, chat: str | None, archive: Path | None) -> tuple[str, Path]:
    """The chat and its archive: an archive given comes before the registered one, and names the chat if that is not given."""
    if archive is not None:
        return (valid_chat(chat) if chat else slug_of(group_name(archive))), archive
    name, registered = active_chat(params, chat), params.get("chats") or {}
    if name not in registered:
        raise ValueError(f"no archive is registered for {name!r}, only for {sorted(registered)}")
    return name, Path(registered[name]).expanduser()


def sha256(path: Path) -> str:
    with path.open("rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def visible(name: str) -> str:
    """Spark takes files that begin with an underscore for hidden ones; _chat.txt becomes chat.txt."""
    folder, _, file = name.rpartition("/")
    return "/".join(filter(None, (folder, file.lstrip("_"))))


def extract(archive: Path, folder: Path, existing: Existing) -> list[Path]:
    """The archive's files with their dates; nothing is written if any would leave the folder."""
    root, out = folder.resolve(), []
    with zipfile.ZipFile(archive) as opened:
        members = [m for m in opened.infolist() if not m.is_dir()]
        for member in members:
            if not (root / member.filename).resolve().is_relative_to(root):
                raise ValueError(f"unsafe path in {archive.name}: {member.filename}")
        for member in members:
            path = root / visible(member.filename)
            if existing.writes(path):
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(opened.read(member))
                stamp = time.mktime((*member.date_time, 0, 0, -1))
                os.utime(path, (stamp, stamp))
            out.append(path)
    return out


def copy(archive: Path, folder: Path, existing: Existing) -> Path:
    """A copy with its date; one kept although it differs is worth a warning."""
    path = folder / archive.name
    folder.mkdir(parents=True, exist_ok=True)
    if existing.writes(path):
        shutil.copy2(archive, path)
    elif sha256(path) != sha256(archive):
        log.warning("%s differs from %s and was kept", path, archive)
    return path


def chat_file(folder: Path) -> Path:
    found = sorted(folder.glob("*.txt"))
    found = [p for p in found if p.name != "FUENTE.txt"]
    if len(found) != 1:
        raise ValueError(f"expected one chat file in {folder}, found {len(found)}")
    return found[0]


def source_text(group: str, about: dict[str, str], files: list[Path], dates: tuple[str, str, int]) -> str:
    """Group, where the data come from, and size, date and digest of each file."""
    lines = [f'Grupo: "{group}"', *(f"{k}: {v}" for k, v in about.items()), f"Periodo: {dates[0]} a {dates[1]} ({dates[2]} mensajes)", "", "Archivos:"]
    for path in files:
        stamp = time.strftime("%Y-%m-%d %H:%M", time.localtime(path.stat().st_mtime))
        lines.append(f"- {path.name}: {path.stat().st_size} bytes, {stamp}, sha256 {sha256(path)}")
    return "\n".join(lines) + "\n"
