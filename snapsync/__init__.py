"""Snapshots of file trees and document tables: compare, chunk, copy, resume and verify them as Spark jobs."""
