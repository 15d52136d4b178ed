"""Tables of a pipeline's steps in the shared folder."""

from strandloom.shared import Workspace, shared_folder

__all__ = ["Workspace", "shared_folder"]
