"""What the training-data operators share: the cluster's shared folder, tables written to it, counted broadcasts."""

from tidewater.storage import fresh_path, if_small, shared_folder, written

__all__ = ["fresh_path", "if_small", "shared_folder", "written"]
