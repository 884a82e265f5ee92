import pytest

from ledgerlog import config, timeparse
from ledgerlog.model import FlushMode, OutputFormat

AT = 1_769_688_000_000_000_000
S = timeparse.SECOND


@pytest.mark.parametrize(("text", "seconds"), [("1h", 3600), ("30m", 1800), ("2d", 172800), ("1h30m", 5400), ("1h 30m", 5400), ("1w", 604800), ("10s", 10)])
def test_durations_count_back_from_now(text, seconds):
    assert timeparse.parse_time(text, AT) == AT - seconds * S


@pytest.mark.parametrize("text", ["2026-01-29 12:00:00", "2026-01-29T12:00:00Z", "2026-01-29T12:00:00", " 2026-01-29 12:00:00Z "])
def test_instants(text):
    assert timeparse.parse_time(text) == AT


def test_dates_and_fractions():
    assert timeparse.parse_time("2026-01-29") == AT - 43200 * S
    assert timeparse.parse_time("2026-01-29T12:00:00.000000001Z") == AT + 1


@pytest.mark.parametrize("text", ["", "   ", "yesterday", "today", "2026-02-30", "1x", "1969-12-31 23:59:59", "2026-01-29T12:00"])
def test_what_is_no_time(text):
    with pytest.raises(ValueError):
        timeparse.parse_time(text, AT)


@pytest.mark.parametrize(("low", "high"), [(100, 200), (100, 100), (None, 200), (100, None), (None, None)])
def test_good_ranges(low, high):
    timeparse.check_range(low, high)


def test_bad_range():
    with pytest.raises(ValueError):
        timeparse.check_range(200, 100)


def test_only_upper_bounds_are_widened_and_only_on_whole_seconds():
    assert timeparse.parse_range("2026-01-29 12:00:00", "2026-01-29 12:00:00") == (AT, AT + S - 1)
    assert timeparse.upper_bound(AT + 1) == AT + 1
    assert timeparse.upper_bound((1 << 63) // S * S) == (1 << 63) - 1


def test_enums():
    assert FlushMode.parse("Cautious") is FlushMode.CAUTIOUS and FlushMode.CAUTIOUS.is_durable and FlushMode.EMERGENCY.is_durable and not FlushMode.NORMAL.is_durable
    assert OutputFormat.parse("HEX") is OutputFormat.HEX
    with pytest.raises(ValueError):
        FlushMode.parse("fast")


def test_layers(tmp_path):
    (tmp_path / "ledgerlog.toml").write_text('[storage]\nmemtable_flush_threshold_mib = 8\ncompaction_threshold = 5\n[wal]\nflush_mode = "normal"\n[sources]\nfiles = ["~/a.log"]\n')
    env = {"LEDGERLOG_COMPACTION_THRESHOLD": "6", "LEDGERLOG_TCP": "127.0.0.1:1,", "LEDGERLOG_STDIN": "maybe"}
    c = config.load({"data_dir": str(tmp_path), "compaction_threshold": None, "flush_mode": FlushMode.EMERGENCY}, env=env)
    assert (c.memtable_flush_threshold, c.compaction_threshold, c.flush_mode, c.tcp, c.stdin) == (8 * config.MIB, 6, FlushMode.EMERGENCY, ("127.0.0.1:1",), False)
    assert c.files[0].endswith("/a.log") and not c.files[0].startswith("~")


def test_defaults_and_sources():
    c = config.load(env={})
    assert (c.memtable_flush_threshold, c.compaction_threshold, c.channel_capacity, c.flush_mode, c.has_source) == (4 * config.MIB, 4, 1024, FlushMode.CAUTIOUS, False)
    assert config.load({"stdin": True}, env={}).has_source


@pytest.mark.parametrize("bad", [{"memtable_flush_threshold": config.MIB - 1}, {"compaction_threshold": 1}, {"channel_capacity": 0}, {"tcp": ("nowhere",)}, {"udp": ("1.2.3.4:70000",)}, {"udp": ("::1:5",)}, {"sometimes": 1}])
def test_bounds(bad):
    with pytest.raises(config.ConfigError):
        config.load(bad, env={})


def test_unknown_keys_of_the_file(tmp_path):
    for text in ("[storage]\nsize = 1\n", "[other]\n"):
        (tmp_path / "x.toml").write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(config_file=str(tmp_path / "x.toml"), env={})


def test_bools_paths_and_addresses():
    assert [config.parse_bool(x) for x in ("TRUE", "1", "yes", "on", "off", "0", "no", "2")] == [True, True, True, True, False, False, False, None]
    assert config.parse_address("[::1]:5000") == ("::1", 5000)
    assert config.expand_path("~x") == "~x"


def test_segment_size():
    from ledgerlog import config

    assert config.load(env={}).segment_size == 16 << 20 and config.load(env={"LEDGERLOG_SEGMENT_SIZE_MIB": "32"}).segment_size == 32 << 20
    for size in (1000, (1 << 20) + 1):
        with pytest.raises(config.ConfigError, match="segment_size_mib"):
            config.load({"segment_size": size}, env={})
