"""A chess club's invented chat, written as a phone exports it: every kind of record, two members and the club itself."""

from dataclasses import dataclass
from datetime import datetime

from corrillo.functions.text import FSI, LRM, NNBSP, PDI

CLUB, INES, OLAF = "Torre y Alfil ♜", "Inés Quiroga", f"~{NNBSP}Olaf Brandt"


@dataclass(frozen=True)
class Message:
    at: datetime
    who: str
    body: str
    kind: str
    marked: bool = False  # whether a direction mark stands before the header

    def line(self) -> str:
        hour = self.at.hour % 12 or 12
        half = "p.m." if self.at.hour >= 12 else "a.m."
        header = f"[{self.at:%d/%m/%y}, {hour}:{self.at:%M:%S}{NNBSP}{half}] {self.who}:"
        return LRM * self.marked + header + (f" {self.body}" if self.body else "")


def _on(day: int, hour: int, minute: int, second: int = 0) -> datetime:
    return datetime(2023, 11, day, hour, minute, second)


MESSAGES = (
    Message(_on(3, 18, 40), CLUB, f"{LRM}Olaf Brandt created this group", "group_notice"),
    Message(_on(3, 18, 41, 7), OLAF, "buenas tardes\n\nempezamos a las ocho", "text"),
    Message(_on(3, 23, 59, 59), INES, f"{LRM}audio omitted", "attachment", marked=True),
    Message(_on(4, 0, 0), INES, f"mesa lista, la puso Olaf {LRM}document omitted", "attachment", marked=True),
    Message(_on(4, 12, 15, 30), OLAF, f"gracias @{FSI}Inés Quiroga{PDI} 🙌🏽, llega Brandt también", "text"),
    Message(_on(4, 12, 16), INES, "", "empty"),
    Message(_on(4, 12, 20), OLAF, "POLL:\n¿Qué apertura jugamos?\nOPTION: Siciliana (2 votes)", "poll"),
    Message(_on(5, 9, 5), INES, f"{LRM}Inés Quiroga changed the group description", "system_notice"),
    Message(_on(5, 9, 6), OLAF, f"{LRM}Location: https://maps.example.org/?q=40.4,-3.7", "location"),
    Message(_on(5, 9, 7), OLAF, f"{LRM}You deleted this message", "deleted"),
    Message(_on(5, 10, 0), INES, f"{LRM}This message can't be displayed here", "unavailable"),
    Message(_on(5, 10, 1), INES, f"{LRM}You received a view once video", "view_once"),
    Message(_on(5, 21, 30), INES, f"jaque mate, Olaf {LRM}<This message was edited>", "text"),
)


def export() -> str:
    return "".join(m.line() + "\r\n" for m in MESSAGES)
