"""Capture files as a Spark data source: ``spark.read.format("capture").load(folder)``, many tasks a file.

Only header fields are read; a packet becomes one row of the packet schema plus its capture's name. ``packet_seq`` is the
byte at which the packet's record begins: unique and ascending in arrival order within a file, whatever the splits.

A file is cut every ``splitBytes`` bytes. A task starts at the first place in its range from which record headers follow
each other for longer than any one record can be, and reads the records that begin in its range. The task before it reads
on to the same place and compares: as the first task starts behind the file's own header, every start is proven in turn,
and where one is wrong (records told inside a packet's payload) the read fails and names ``splitBytes=0``, which reads files whole.
"""

from __future__ import annotations

import io
import ipaddress
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "capture string, packet_seq long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
    "proto string, pkt_len long, tcp_flags int, win_size int, header_len int, tcp_header_len int"
)
ARROW = pa.schema([
    ("capture", pa.string()), ("packet_seq", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("src_ip", pa.string()), ("dst_ip", pa.string()),
    ("src_port", pa.int32()), ("dst_port", pa.int32()), ("proto", pa.string()), ("pkt_len", pa.int64()), ("tcp_flags", pa.int32()),
    ("win_size", pa.int32()), ("header_len", pa.int32()), ("tcp_header_len", pa.int32()),
])
BATCH_ROWS = 8192
SPLIT_BYTES = 64 << 20
# Link types whose frames start with this many bytes before the type field or the IP header
ETHERNET, RAW_IP, LINUX_SLL = 1, (101, 12, 14), 113
#: the longest record that a split file may hold
LONGEST = 1 << 18
#: seconds between packets of a file that is split, at most: about ten years
TIME_SPAN = 315_000_000
# Block types of packets, names, statistics, secrets and custom blocks
KINDS = (1, 2, 3, 4, 5, 6, 9, 10, 0xBAD, 0x40000BAD)
CLASSIC = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}
SECTION = b"\x0a\x0d\x0d\x0a"


def file_of(path: str):
    """(file system, path in it); a path without a scheme is local."""
    return files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path)


def open_file(path: str):
    system, name = file_of(path)
    return io.BufferedReader(system.open_input_file(name), 1 << 20)


class Ambiguous(ValueError):
    def __init__(self, path: str, at: int):
        super().__init__(f"records of {path} cannot be told apart near byte {at}; read it with splitBytes=0")


@dataclass
class Classic:
    """A capture file with a 16-byte header a record."""

    order: str
    nano: bool
    link: int
    #: most bytes kept of a packet, and the first packet's time
    most: int
    first: int
    begin: int = 24

    def record(self, head: bytes) -> int | None:
        """The size of the record that begins with ``head``, or None if it cannot be one."""
        if len(head) < 16:
            return None
        seconds, fraction, kept, length = struct.unpack(self.order + "IIII", head[:16])
        fits = 0 < kept <= self.most and kept <= length <= LONGEST and abs(seconds - self.first) <= TIME_SPAN
        return 16 + kept if fits and fraction < (1_000_000_000 if self.nano else 1_000_000) else None

    def packets(self, stream, start: int):
        """(place, link type, microseconds, frame bytes) of the records from ``start`` on; frame None: not a packet."""
        stream.seek(start)
        while len(head := stream.read(16)) == 16:
            seconds, fraction, kept, _ = struct.unpack(self.order + "IIII", head)
            yield start, self.link, seconds * 1_000_000 + (fraction // 1000 if self.nano else fraction), stream.read(kept)
            start += 16 + kept


@dataclass
class Blocks:
    """A block-structured capture file; ``links``: link type and clock of each interface named before the first packet."""

    order: str
    links: list
    begin: int

    def record(self, head: bytes) -> int | None:
        if len(head) < 12:
            return None
        kind, size = struct.unpack(self.order + "II", head[:8])
        return size if kind in KINDS and 12 <= size <= LONGEST and size % 4 == 0 else None

    def packets(self, stream, start: int):
        stream.seek(start)
        order, links = self.order, list(self.links)
        while len(head := stream.read(8)) == 8:
            if head[:4] == SECTION:
                order = "<" if stream.read(4) == b"\x4d\x3c\x2b\x1a" else ">"
                size = struct.unpack(order + "I", head[4:])[0]
                stream.read(size - 12)
                links = []
                yield start, None, 0, None
                start += size
                continue
            kind, size = struct.unpack(order + "II", head)
            body = stream.read(size - 8)[:-4]
            if kind == 1:
                links.append((struct.unpack(order + "H", body[:2])[0], resolution(body[8:], order)))
                yield start, None, 0, None
            elif kind == 6:
                interface, high, low, kept, _ = struct.unpack(order + "IIIII", body[:20])
                link, ticks = links[interface]
                yield start, link, ((high << 32) | low) * 1_000_000 // ticks, body[20:20 + kept]
            elif kind == 3 and links:
                length = struct.unpack(order + "I", body[:4])[0]
                yield start, links[0][0], 0, body[4:4 + length]
            start += size


def form_of(stream, path: str) -> Classic | Blocks:
    magic = stream.read(4)
    if magic == SECTION:
        stream.seek(0)
        head = stream.read(12)
        order = "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"
        at, links = struct.unpack(order + "I", head[4:8])[0], []
        stream.seek(at)
        while len(head := stream.read(8)) == 8 and struct.unpack(order + "I", head[:4])[0] == 1:
            size = struct.unpack(order + "I", head[4:])[0]
            body = stream.read(size - 8)[:-4]
            links.append((struct.unpack(order + "H", body[:2])[0], resolution(body[8:], order)))
            at += size
        return Blocks(order, links, at)
    order = CLASSIC.get(magic)
    if order is None:
        raise ValueError(f"not a capture file: {path}")
    most, link = struct.unpack(order + "II", stream.read(20)[12:])
    head = stream.read(4)
    first = struct.unpack(order + "I", head)[0] if len(head) == 4 else 0
    return Classic(order, b"\x3c" in magic, link, min(most or LONGEST, LONGEST), first)


def first_record(stream, form: Classic | Blocks, start: int, size: int) -> int:
    """The first place from ``start`` on from which records follow each other over ``LONGEST`` bytes or to the end."""
    step = 4 if isinstance(form, Blocks) else 1
    stream.seek(start)
    # a start within one longest record, then a chain as long as one, and the header behind it
    window = stream.read(2 * LONGEST + 64)
    best, most = size, 0
    for at in range(-start % step, min(LONGEST + 1, len(window)), step):
        place, chained = at, 0
        while place < at + LONGEST and start + place < size:
            length = form.record(window[place:place + 16])
            if length is None or (step == 4 and window[place + 4:place + 8] != window[place + length - 4:place + length] and place + length <= len(window)):
                break
            place += length
            chained += 1
        else:
            if start + place == size or place >= at + LONGEST:
                return start + at
            # a file may end inside its last record: then the longest chain to there counts
            if chained > most:
                best, most = start + at, chained
    return best


def resolution(options: bytes, order: str) -> int:
    """Clock ticks per second of an interface (option 9), a million when not given."""
    while len(options) >= 4:
        code, size = struct.unpack(order + "HH", options[:4])
        if code == 9:
            raw = options[4]
            return 2 ** (raw & 0x7F) if raw & 0x80 else 10 ** raw
        options = options[4 + (size + 3) // 4 * 4:]
    return 1_000_000


def network_layer(link: int, frame: bytes) -> bytes | None:
    """The IP packet inside a frame, or None for other traffic."""
    if link in RAW_IP:
        return frame
    at = {ETHERNET: 12, LINUX_SLL: 14}.get(link)
    if at is None or len(frame) < at + 2:
        return None
    kind = frame[at:at + 2]
    while kind in (b"\x81\x00", b"\x88\xa8") and len(frame) >= at + 6:
        at += 4
        kind = frame[at:at + 2]
    return frame[at + 2:] if kind in (b"\x08\x00", b"\x86\xdd") else None


def headers(packet: bytes) -> tuple | None:
    """(src, dst, sport, dport, protocol, flags, window, segment length, header length) or None."""
    if not packet:
        return None
    version = packet[0] >> 4
    if version == 4 and len(packet) >= 20:
        protocol, start = packet[9], (packet[0] & 15) * 4
        end = min(len(packet), max(start, struct.unpack(">H", packet[2:4])[0] or len(packet)))
        later_fragment = struct.unpack(">H", packet[6:8])[0] & 0x1FFF
        src, dst = packet[12:16], packet[16:20]
    elif version == 6 and len(packet) >= 40:
        protocol, start, later_fragment = packet[6], 40, 0
        end = min(len(packet), 40 + struct.unpack(">H", packet[4:6])[0])
        src, dst = packet[8:24], packet[24:40]
        while protocol in (0, 43, 44, 60) and len(packet) >= start + 8:
            if protocol == 44:
                later_fragment = struct.unpack(">H", packet[start + 2:start + 4])[0] >> 3
            protocol, start = packet[start], start + (8 if protocol == 44 else (packet[start + 1] + 1) * 8)
    else:
        return None
    ends = str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst))
    body = packet[start:end]
    if later_fragment:
        return *ends, 0, 0, "OTHER", 0, 0, 0, 0
    if protocol == 6 and len(body) >= 20:
        sport, dport = struct.unpack(">HH", body[:4])
        return *ends, sport, dport, "TCP", body[13], struct.unpack(">H", body[14:16])[0], len(body), (body[12] >> 4) * 4
    if protocol == 17 and len(body) >= 8:
        return *ends, *struct.unpack(">HH", body[:4]), "UDP", 0, 0, 8, 0
    return *ends, 0, 0, "ICMP" if protocol == 1 and version == 4 else "OTHER", 0, 0, 0, 0


class CaptureFile(InputPartition):
    """Records of ``path`` that begin in [start, end); ``end`` None: the whole file."""

    def __init__(self, path: str, size: int, start: int = 0, end: int | None = None):
        self.path, self.size, self.start, self.end = path, size, start, end


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.limit = int(options.get("maxPackets", 0))
        # a cap counts from the file's beginning, so such a file is read whole
        self.split = 0 if self.limit else int(options.get("splitBytes", SPLIT_BYTES))
        system, name = file_of(path)
        scheme = path[:len(path) - len(name)] if path.endswith(name) else ""
        info = system.get_file_info(name)
        found = system.get_file_info(files.FileSelector(name, recursive=True)) if info.type == files.FileType.Directory else [info]
        wanted = [f for f in found if f.type == files.FileType.File and (f is info or f.extension in ("pcap", "pcapng"))]
        self.files = sorted((scheme + f.path, f.size) for f in wanted)

    def partitions(self):
        out = []
        for path, size in self.files:
            if not self.split or size <= self.split:
                out.append(CaptureFile(path, size))
            else:
                out += [CaptureFile(path, size, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out

    def _packets(self, part: CaptureFile):
        with open_file(part.path) as stream:
            form = form_of(stream, part.path)
            start = form.begin if part.start == 0 else first_record(stream, form, part.start, part.size)
            if isinstance(form, Blocks) and part.end is None:
                start = 0
            seen = start
            for count, (place, link, micros, frame) in enumerate(form.packets(stream, start)):
                seen = place
                if (part.end is not None and place >= part.end) or (self.limit and count >= self.limit):
                    break
                if frame is None:
                    # other splits do not know of a section or an interface that comes between packets
                    if part.end is not None:
                        raise Ambiguous(part.path, place)
                    continue
                yield place, link, micros, frame
            else:
                seen = part.size
            if part.end is not None and part.end < part.size and first_record(stream, form, part.end, part.size) != seen:
                raise Ambiguous(part.path, part.end)

    def read(self, partition: CaptureFile):
        rows = []
        for place, link, micros, frame in self._packets(partition):
            packet = network_layer(link, frame)
            found = headers(packet) if packet is not None else None
            if found is None:
                continue
            src, dst, sport, dport, proto, flags, window, segment, header = found
            rows.append((partition.path, place, micros, src, dst, sport, dport, proto, len(frame), flags, window, segment, header))
            if len(rows) == BATCH_ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(self.options)


def read_captures(spark: SparkSession, path: str, max_packets: int | None = None, split_bytes: int | None = None):
    """Packets of all capture files below ``path``, local or with the scheme of a file system that every executor
    reaches; no cap unless asked for. ``split_bytes``: 0 reads files whole."""
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("capture")
    if split_bytes is not None:
        reader = reader.option("splitBytes", str(split_bytes))
    if max_packets:
        reader = reader.option("maxPackets", str(max_packets))
    return reader.load(path)
