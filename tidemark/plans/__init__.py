"""What decides which files a query reads: the commit log and its snapshots."""

from tidemark.plans.commitlog import CommitLog, Edit, FileEntry, Snapshot

__all__ = ["CommitLog", "Edit", "FileEntry", "Snapshot"]
