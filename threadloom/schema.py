"""The archive's flat relations, limits and messages."""

from __future__ import annotations

from dataclasses import dataclass

MEMBER = "archive string, path string, size_bytes long, compressed_size_bytes long, crc32 long, compression_method int, flag_bits int, unix_mode int, is_directory boolean"
FILE = "path string, size_bytes long, compressed_size_bytes long, crc32 long, compression_method int, sha256 string, detected_kind string, is_readable boolean"
WARNING = "severity string, code string, source_path string, conversation_id string, node_id string, location string, context string"
BLOCK = "block_pos int, type string, text string, language string, reference string, source_content_type string, metadata string"
MESSAGE = f"message_id string, role string, author_name string, created_at timestamp, updated_at timestamp, content array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>, model string, recipient string, status string, end_turn boolean, metadata string, source_extras string"
NODE = "source_index long, node_id string, parent_node_id string, children_node_ids array<string>, source_children_node_ids array<string>, is_on_current_path boolean, path_pos int, source_extras string"
CONVERSATION = "source_index long, conversation_id string, title string, created_at timestamp, updated_at timestamp, source_path string, record_index long, current_node_id string, source_extras string"


@dataclass(frozen=True)
class Limits:
    """Hard bounds on what is read. Exceeding one is an error or a finding, never a silent cut."""

    max_archive_bytes: int = 8 * 1024**3
    max_files: int = 100_000
    max_total_uncompressed_bytes: int = 20 * 1024**3
    max_member_uncompressed_bytes: int = 2 * 1024**3
    max_json_bytes: int = 512 * 1024**2
    max_total_json_bytes: int = 2 * 1024**3
    max_compression_ratio: float = 250.0
    min_ratio_check_bytes: int = 1024**2
    max_conversations: int = 200_000
    max_nodes_per_conversation: int = 100_000
    max_total_nodes: int = 5_000_000
    max_warnings: int = 10_000
    read_chunk_bytes: int = 1024**2


class ArchiveError(Exception):
    """What stops the reading of an archive; messages never hold content."""


class InvalidArchive(ArchiveError):
    pass


class UnsafeArchive(ArchiveError):
    def __init__(self, codes: list[str]):
        super().__init__("the archive failed its preflight: " + ", ".join(codes))
        self.codes = codes


class LimitExceeded(ArchiveError):
    pass


class AmbiguousPayload(ArchiveError):
    pass


class PayloadNotFound(ArchiveError):
    pass


class InvalidPayload(ArchiveError):
    pass


class UnsupportedSchema(ArchiveError):
    pass


class StrictModeViolation(ArchiveError):
    pass
