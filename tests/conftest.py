import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

UNSERIALIZABLE: list[str] = []


@pytest.fixture(scope="session")
def spark():
    from prismill.session import local_session

    return local_session("tests", 8, "8g")


@pytest.hookimpl(hookwrapper=True)
def pytest_runtest_makereport(item, call):
    """Keep the part of a serialisation error that names the object: reports cut long traces off."""
    yield
    text = str(call.excinfo.value) if call.excinfo else ""
    if "not serializable" in text or "NotSerializableException" in text:
        lines = [line.strip() for line in text.splitlines() if "erializ" in line or line.lstrip().startswith("- ")]
        UNSERIALIZABLE.append(f"{item.name}: " + " | ".join(line[:200] for line in lines[:12]))


def pytest_terminal_summary(terminalreporter):
    for line in UNSERIALIZABLE:
        terminalreporter.write_line(f"not serializable in {line}")
