"""Readers: tables, sequence flat files, catalogs, matrices, edges, trees and annotations."""
