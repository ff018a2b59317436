"""The part of h5py's interface that the readers use, over pickled trees: the container has no HDF5."""

import pickle

import numpy as np


class Dataset:
    def __init__(self, name, data):
        self.name, self.data, self.attrs = name, np.asarray(data), {}
        self.shape, self.dtype = self.data.shape, self.data.dtype

    def __getitem__(self, at):
        return self.data[at]

    def __len__(self):
        return len(self.data)


class Group:
    def __init__(self, name=""):
        self.name, self.attrs, self.nodes = name, {}, {}

    def _find(self, path):
        node = self
        for part in path.strip("/").split("/"):
            if not isinstance(node, Group) or part not in node.nodes:
                return None
            node = node.nodes[part]
        return node

    def __contains__(self, path):
        return self._find(path) is not None

    def __getitem__(self, path):
        if (node := self._find(path)) is None:
            raise KeyError(path)
        return node

    def __iter__(self):
        return iter(self.nodes)

    def keys(self):
        return self.nodes.keys()

    def create_group(self, path):
        node = self
        for part in path.strip("/").split("/"):
            node = node.nodes.setdefault(part, Group(f"{node.name}/{part}"))
        return node

    def create_dataset(self, path, data, **_):
        folder, _, last = path.rpartition("/")
        node = self.create_group(folder) if folder else self
        node.nodes[last] = Dataset(f"{node.name}/{last}", data)
        return node.nodes[last]


class File(Group):
    def __init__(self, path, mode="r"):
        super().__init__()
        self.path, self.mode = path, mode
        if mode == "r":
            with open(path, "rb") as f:
                self.attrs, self.nodes = pickle.load(f)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode == "w":
            with open(self.path, "wb") as f:
                pickle.dump((self.attrs, self.nodes), f)
