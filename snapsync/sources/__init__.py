"""Manifests from file trees and tables, and the tables that state is kept in."""
